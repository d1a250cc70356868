import __spark_entry__


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert "mask_documents" in names
