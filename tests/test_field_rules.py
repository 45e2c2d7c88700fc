"""Field rules: own rules win, order and priority of made ones, limit, blanks and empty tables."""

from evigraph.operators import ontology as O


def test_default_field_rules(spark):
    labels = "project_id string, ord long, label string"
    important = spark.createDataFrame([("p", 0, "b"), ("p", 1, " b "), ("p", 2, ""), ("own", 0, "x")], labels)
    required = spark.createDataFrame([("p", i, f"r{i:02d}") for i in range(40)] + [("p", 50, None), ("q", 0, "only"), ("q", 1, "next")], labels)
    own = spark.createDataFrame([("own", "k", "kept", "low")], "project_id string, id string, label string, priority string")
    got = {(r.project_id, r.id): (r.label, r.priority) for r in O.default_field_rules(important, required, own).collect()}
    want = {("p", f"field-{i + 1}"): (x, "critical" if i < 3 else "high") for i, x in enumerate(["b", *[f"r{i:02d}" for i in range(31)]])}
    assert got == want | {("own", "k"): ("kept", "low"), ("q", "field-1"): ("only", "critical"), ("q", "field-2"): ("next", "high")}
    none = important.limit(0)
    assert O.default_field_rules(none, none, own.limit(0)).count() == 0
