"""The entry holds every operator of the subpackage: an import that fails inside it must not pass unseen."""

import __spark_entry__

NUMBERS = range(1, 14)


def test_all_are_registered():
    known = __spark_entry__.queries()
    for k in NUMBERS:
        assert len([name for name in known if name.startswith(f"op{k}_")]) == 1
    assert "pipeline" in known


def test_sql_twins_stand_for_registered_queries():
    twins = {name for name in __spark_entry__.oracle_sql() if name.startswith("op")}
    assert {name.split("_")[0] for name in twins} == {"op1", "op3", "op6", "op8", "op12"}
