"""A streamed folder gives the same cells as a batch."""

from plectra.operators import binning as B
from plectra.plans import fixtures as fx
from plectra.sources import pairs_text as P
from plectra.streaming import ingest


def test_streamed_cells_equal_the_batch(spark, sf_dir, tmp_path):
    pairs = fx.pairs(spark, sf_dir).where("chr1 = 1").withColumns({"frag1": fx.F.lit(0), "frag2": fx.F.lit(1)})
    P.to_lines(pairs, 9).coalesce(2).write.text(str(tmp_path / "in"))
    cells = ingest.stream_contacts(ingest.stream_pairs(spark, str(tmp_path / "in"), 9), 10000)
    query = cells.writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("cells").select(*B.KEYS, "counts").collect()}
    want = {tuple(r) for r in B.bin_contacts(pairs, [10000]).select(*B.KEYS, "counts").collect()}
    assert got == want
