from rheolake.llm import registry


def test_every_check_is_sql():
    assert all(isinstance(sql, str) for sql in registry.oracle_sql().values())
    assert set(registry.oracle_sql()) <= set(registry.queries())
