"""The closure of a relation reaches as far as its edges do."""

from tracemill.operators.search_tree import closure


def test_closure_of_a_long_chain_a_cycle_and_nulls(spark):
    chain = [(i, i + 1) for i in range(30)]
    edges = spark.createDataFrame([*chain, chain[0], (100, 101), (101, 100), (None, 100), (101, None)], "src bigint, dst bigint")
    found = [tuple(r) for r in closure(edges).collect()]
    expected = {(a, b) for a in range(31) for b in range(a + 1, 31)} | {(a, b) for a in (100, 101, None) for b in (100, 101, None)}
    assert len(found) == len(set(found)) and set(found) == expected
