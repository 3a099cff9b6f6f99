import zipfile

import pytest
from pyspark.sql import functions as F

from taxolyte.sources import labels, warehouse, xlsx

HEAD = ["code", "name", "level"]
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets):
    """A workbook with inline strings and numbers."""

    def cell(v, ref):
        return "" if v is None else f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, int | float) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {_NS}><sheets>{names}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{n}">' + "".join(cell(v, f"{chr(65 + k)}{n}") for k, v in enumerate(r)) + "</row>" for n, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {_NS}><sheetData>{body}</sheetData></worksheet>")


def read(spark, path):
    spark.dataSource.register(xlsx.WorkbookSource)
    return spark.read.format("workbook").option("path", str(path)).option("header", "|".join(HEAD)).load()


def test_workbook(spark, tmp_path):
    path = tmp_path / "a.xlsx"
    workbook(path, {"one": [HEAD, ["01", "x", 5.0], [None, None, None], ["02", "y", None]], "two": [HEAD, ["03", "z", 2.5]]})
    got = sorted(tuple(r) for r in read(spark, path).collect())
    assert got == [("one", 2, "01", "x", "5"), ("one", 4, "02", "y", None), ("two", 2, "03", "z", "2.5")]
    assert xlsx.resolve(None, str(tmp_path)) == path and len(xlsx.sha256(path)) == 64


def test_wrong_header(spark, tmp_path):
    path = tmp_path / "a.xlsx"
    workbook(path, {"one": [["code", "other"], ["01", "x"]]})
    with pytest.raises(Exception, match="Unexpected header"):
        read(spark, path).collect()


def landing_rows(spark):
    base = ["01", "M", "02", "Mi", "03", "Mn", "04", "D", "0102030401_20v2", "U", "5.0", "0102030401_20v2 1", "E", "", "1", "can do", "01", "knowledge", "1", "item"]
    rows = [base, base[:-1] + ["other"], [None] * 20, [" "] * 20]
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in warehouse.LANDING))


def test_normalize(spark):
    raw = warehouse.landing(landing_rows(spark))
    assert raw.count() == 2 and {r["unit_level"] for r in raw.collect()} == {5} and warehouse.violations(raw).count() == 0
    t = warehouse.normalize(raw)
    assert {k: v.count() for k, v in t.items()} == dict.fromkeys(t, 1) | {"kta_items": 2}
    assert t["competency_unit_elements"].first()["element_no"] == "1"
    assert warehouse.edges(t).count() == 8
    assert warehouse.paths(t).first()["detail_full_code"] == "01020304"
    again = warehouse.normalize(raw.orderBy(F.desc("item")))
    assert sorted(again["kta_items"].collect()) == sorted(t["kta_items"].collect())


def test_violations(spark):
    rows = warehouse.landing(landing_rows(spark)).withColumn("item", F.lit(None).cast("string"))
    assert warehouse.violations(rows).count() == 2


def test_upserts(spark):
    old, new = (spark.createDataFrame(x, "code int, name string") for x in ([(1, "a"), (2, "b")], [(2, "B"), (3, "c"), (3, "c")]))
    assert sorted(map(tuple, warehouse.insert_if_absent(old, new, ["code"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, warehouse.upsert(old, new.distinct(), ["code"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_label_sets(spark, tmp_path):
    (tmp_path / "skills_en.csv").write_text('﻿conceptUri,preferredLabel,altLabels,skillType,reuseLevel,description,status\nu1,Read,"read books\nreading",s,r,d,released\nu2,Old,,s,r,d,obsolete\n', encoding="utf-8")
    (tmp_path / "occupations_en.csv").write_text("conceptUri,preferredLabel,altLabels,iscoGroup,code,description,status\no1,Reader,,2622,,d,\n", encoding="utf-8")
    (tmp_path / "occupationSkillRelations.csv").write_text("occupationUri,relationType,skillUri\no1,essential,u1\no1,optional,u9\n", encoding="utf-8")
    files = labels.csv_set(str(tmp_path))
    s = labels.skills(labels.read_csv(spark, labels.pick(files, "skills_en")))
    o = labels.occupations(labels.read_csv(spark, labels.pick(files, "occupations_")))
    assert s.first()["altLabels"] == ["read books", "reading"] and s.count() == 1 and o.first()["code"] == "2622"
    r = labels.relations(labels.read_csv(spark, labels.pick(files, "relations")), o, s)
    assert [tuple(x) for x in r.collect()] == [("o1", "u1", "essential")]
    assert {x["surface"] for x in labels.surfaces(s).collect()} == {"Read", "read books", "reading"}


def test_version_verdict(spark):
    delta = spark.createDataFrame([("altLabels", "en", "u", "added", "x"), ("altLabels", "en", "u", "removed", "y")], "field string, language string, uri string, action string, value string")
    for label, want in (("x", "new"), ("y", "old")):
        assert labels.version_verdict(delta, spark.createDataFrame([("u", label)], "uri string, label string")).first()["verdict"] == want


def test_closure(spark):
    narrower = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    assert {r["node"] for r in labels.closure(spark, spark.createDataFrame([("a",)], "node string"), narrower).collect()} == {"a", "b", "c"}
