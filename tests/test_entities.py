"""Entities of eleven kinds on written texts."""

from tracequarry.operators import entities

TEXT = """JIRA: STUD-101, stud-9. Attribute: gpa, `Level` ; Scenario: STUDENT_UPDATE.
Endpoint: /api/students, api/none
File: src/StudentService.java, pom.xml. Class: Student, GPA
Changed files = a.py; commit 1a2b3c4d and COMMIT deadbeef99. Commit id: 77.
post /x/y?z=1, Get /x and PATCHED. release name: r1, R1. In september 2026 and MAY 1999
StudentMapper calls helper.load() and save( ) but not Put(x). Test case: T1. GpaTest, GpaTests, Testing
Add a new Student attribute named temporaryLocation. level belongs to the Course. A field called extra.
2. Out of scope
hidden belongs to the Secret.
3. Next section
open belongs to Door.
"""


def found(spark, text, kind, **how):
    df = spark.createDataFrame([(1, kind, text)], "doc_id int, source_type string, text string")
    out = {}
    for r in entities.extracted(df, **how).orderBy("kind", "rank").collect():
        out.setdefault(r.kind, []).append(r.entity)
    return out


def test_eleven_kinds(spark):
    got = found(spark, TEXT, "Requirement")
    assert got["jira_ids"] == ["STUD-101"] and got["scenarios"] == ["STUDENT_UPDATE"] and got["http_methods"] == ["POST", "GET", "PUT"]
    assert got["attributes"] == ["gpa", "Level", "temporaryLocation", "open", "extra"]
    assert got["endpoints"] == ["/x/y?z=1", "/x", "/api/students"] and got["files"] == ["src/StudentService.java", "pom.xml", "a.py"]
    assert got["classes"] == ["Student", "GPA", "Course", "Door", "StudentService", "StudentMapper"]
    assert got["methods"] == ["load", "save"] and got["release_names"] == ["September 2026", "r1"]
    assert got["tests"] == ["T1", "GpaTest", "GpaTests"] and got["commits"] == ["77", "1a2b3c4d", "deadbeef99"]


def test_types_and_limits(spark):
    mapping = found(spark, TEXT, "MAPPING")
    assert "endpoints" not in mapping and mapping["attributes"] == ["gpa", "Level"] and "Door" not in mapping["classes"]
    many = " ".join(f"AB-{i}" for i in range(150)) + " ab-3 AB-3"
    assert len(found(spark, many, None)["jira_ids"]) == 100 and len(found(spark, many, None, first=None)["jira_ids"]) == 150
    assert found(spark, None, None) == {} and found(spark, "", "JIRA") == {}
    again = spark.createDataFrame([(1, "x", "AB-1"), (1, "x", "AB-2")], "doc_id int, source_type string, text string")
    assert entities.extracted(again).count() == 2 and entities.extracted(again.limit(0)).count() == 0
