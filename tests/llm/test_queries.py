"""Every query against its SQL on whole small tables."""

from lodestrata.llm import queries as q


def test_queries_agree_with_sql(spark, sf):
    from compare import compare, connect

    con = connect(sf)
    for name, f in q.QUERIES.items():
        if name in q.SQL:
            assert compare(spark, con, name, f, q.SQL[name], sf) == "", name


def test_columns(spark, sf):
    want = {
        "p2_found": ["id_a", "id_b"], "p4_found": ["arrival_no"], "p5_found": ["field", "id_a", "id_b"], "p7_ids": ["doc_id", "ids"],
        "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
    }
    for name, columns in want.items():
        assert q.QUERIES[name](spark, sf).columns == columns, name
