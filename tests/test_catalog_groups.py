"""Proposed groups take all eligible claims, whatever their names begin with."""

from evigraph.sources.fixtures import catalog_groups


def test_every_eligible_claim_is_in_groups_of_its_name_and_its_type(spark):
    rows = [("p", "c1", "azure", "T1", "candidate"), ("p", "c2", "red", "T1", "attach"), ("p", "c3", "azure", "T2", "attach"), ("q", "c4", "azure", "T1", "candidate"), ("p", "c5", None, "T1", "ignore")]
    claims = spark.createDataFrame(rows, "project_id string, claim_id string, suggested_name string, suggested_type string, disposition string")
    groups, members = catalog_groups(claims)
    assert sorted(map(tuple, members.collect())) == [
        ("1|p|azure", "c1", "merge"), ("1|p|azure", "c3", "keep_separate"), ("1|p|red", "c2", "keep_separate"), ("1|q|azure", "c4", "merge"),
        ("2|p|T1", "c1", "merge"), ("2|p|T1", "c2", "keep_separate"), ("2|p|T2", "c3", "keep_separate"), ("2|q|T1", "c4", "merge"),
    ]
    assert sorted((g["group_id"], g["canonical"]) for g in groups.collect()) == [("1|p|azure", "c1"), ("1|p|red", "c2"), ("1|q|azure", "c4"), ("2|p|T1", "c1"), ("2|p|T2", "c3"), ("2|q|T1", "c4")]
