"""Type references of an owner reach the children that its details name, by an equi-join on pieces of the details."""

from codeloom.operators import graph


def test_details_meet_names_by_pieces(spark):
    objects = spark.createDataFrame([("a", "Имя", "p"), ("b", "Имя1", "p"), ("c", "x.*", "p"), ("d", "", "p"), ("e", "Имя", "q"), ("f", None, "p"), ("g", "Имя", None)], "id string, name string, parent_id string")
    refs = spark.createDataFrame([("p", "t1", "Реквизит Имя1 ИмяИмя", "type"), ("p", "t2", "", "type"), ("p", "t3", None, "type"), ("p", "t0", "a x.* b", "type"), ("p", "t4", "Имя", "other"), ("a", "t9", None, "type")], "source_id string, target_id string, detail string, context string")
    out = graph.type_info(objects, refs)
    assert {r.id: r.types for r in out.collect()} == {"a": "t9,t1", "b": "t1", "c": "t0", "d": "t0,t1,t2"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan and "contains(" not in plan.lower()
