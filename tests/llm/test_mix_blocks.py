"""Blocks of a mix have the size asked for, whatever the size of the table."""

import pytest

from voxelloom.llm import mixing


# Beyond half a million documents, blocks of one used to become blocks of more.
@pytest.mark.parametrize("n", [400, 520_000])
def test_mix_blocks_do_not_depend_on_the_size(spark, n):
    df = spark.range(n).selectExpr("id as doc_id", "concat('s', id % 3) as source", "'x' as text")
    plan = mixing.plan_mix(df, block_docs=1)
    seen = plan.selectExpr("max(place) as place", "count(distinct doc_id) as docs", "count(distinct slot) as slots").first()
    assert seen.place == 0 and seen.docs == n and seen.slots >= n
