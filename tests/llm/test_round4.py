"""What the findings of the fourth round asked of the corpus operators."""
from leafmill.llm import simhash
from leafmill.llm.common import cut


def test_postings_are_not_broadcast(spark):
    """An explode is sized as the table it comes from, so a table below the limit may have postings far above it."""
    links = simhash.link_fingerprints(cut(spark.range(200).withColumnRenamed("id", "fp")))
    assert {(a, b) for a, b in links.collect()} == {(a, b) for b in range(200) for a in range(b) if (a ^ b).bit_count() <= 4}
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
