"""Pages, SQLite files and workbooks by hand."""

import pytest
from pyspark.sql import functions as F

from skein.sources import pages as P
from skein.sources import snapshots as S

PAGES = [
    ("<html><body><nav>menu</nav><div>a<p>b &amp; c</p></div><script>var x = '</p>';</script></body></html>", "a\nb & c", "a\nb & c"),
    ("<header>top</header><div class='x content y'>in <b>bold</b><div>deeper</div> end</div>after", "in\nbold\ndeeper\nend", "in\nbold\ndeeper\nend"),
    ("<div class=contents>no</div><span class=content>yes</span>", "no\nyes", "yes"),
    ("<article>one</article><main>two<main>inner</main>tail</main>out", "two\ninner\ntail", "two\ninner\ntail"),
    ("<nav><article>gone</article></nav><section>kept<br>line</section>", "kept\nline", "kept\nline"),
    ("<p id=content>by id</p><p>other</p>", "by id\nother", "by id"),
    ("<main>never closed <i>but read", "never closed\nbut read", "never closed\nbut read"),
    ("x<!-- <main>no</main> -->y\n\n\n\nz", "x\ny\n\nz", "x\ny\n\nz"),
    ("", "", ""),
    (None, "", ""),
]


def test_main_parts_by_hand(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(PAGES)], "id long, h string")
    for selectors, k in ((P.FILE_MAIN, 1), (P.SITE_MAIN, 2)):
        got = {r.id: r.text for r in P.extracted(df, "id", "h", selectors).collect()}
        assert [got[i] for i in range(len(PAGES))] == [p[k] for p in PAGES]
    assert P.extracted(df.limit(0), "id", "h").count() == 0


def test_sqlite_round_trip(spark, tmp_path, monkeypatch):
    import sqlite3

    S.register(spark)
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("t"), (F.col("id") / 4).alias("x"))
    folder = f"file://{tmp_path}/db"
    df.repartition(3).write.format("sqlite").option("path", folder).option("table", "kept").mode("append").save()
    back = spark.read.format("sqlite").option("path", folder).option("table", "kept").load()
    assert [f.dataType.simpleString() for f in back.schema] == ["bigint", "string", "double"]
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    with sqlite3.connect(tmp_path / "alone.sqlite") as db:
        db.execute("CREATE TABLE data (a INTEGER, b BLOB)")
        db.executemany("INSERT INTO data VALUES (?, ?)", [(i, str(i)) for i in range(25)])
        db.execute("DELETE FROM data WHERE a % 2 = 1")
    monkeypatch.setattr(S, "ROWS", 10)
    one = S.SqliteReader(f"file://{tmp_path}/alone.sqlite", "data", back.select(F.col("id").alias("a")).schema)
    assert len(one.partitions()) == 3 and sorted(r[0] for p in one.partitions() for r in one.read(p)) == list(range(0, 25, 2))
    with pytest.raises(Exception, match="overwritten"):
        df.write.format("sqlite").option("path", folder).mode("overwrite").save()


def test_workbooks(spark, tmp_path):
    import io
    import zipfile

    (tmp_path / "in").mkdir()
    made = S.workbook({"First & last": [["a", None, 'q"<'], [1, 2.5, None]], "Empty": [], "Wide": [[None] * 30 + ["far"]]})
    (tmp_path / "in" / "a.xlsx").write_bytes(made)
    assert list(S.sheet_rows(io.BytesIO(made))) == [("First & last", 1, ["a", None, 'q"<']), ("First & last", 2, ["1", "2.5"]), ("Wide", 1, [None] * 30 + ["far"])]
    # Shared texts, in runs too, and cells without places.
    main = S.MAIN[1:-1]
    with zipfile.ZipFile(io.BytesIO(made)) as old, zipfile.ZipFile(tmp_path / "in" / "b.xlsx", "w") as new:
        for n in old.namelist():
            new.writestr(n, old.read(n) if "sheet1" not in n else f'<worksheet xmlns="{main}"><sheetData><row r="4"><c t="s"><v>1</v></c><c t="s"><v>0</v></c></row></sheetData></worksheet>')
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>plain</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>')
    S.register(spark)
    rows = spark.read.format("sheets").option("path", f"file://{tmp_path}/in").load()
    assert sorted((r.file[-6:], r.sheet, r.row, len(r.cells)) for r in rows.collect()) == [("a.xlsx", "First & last", 1, 3), ("a.xlsx", "First & last", 2, 2), ("a.xlsx", "Wide", 1, 31), ("b.xlsx", "First & last", 4, 2), ("b.xlsx", "Wide", 1, 31)]
    assert rows.filter("file LIKE '%b.xlsx' AND row = 4").first().cells == ["two runs", "plain"]


def test_small_workbooks_share_a_task(spark, tmp_path, monkeypatch):
    for k in range(20):
        (tmp_path / f"{k:02d}.xlsx").write_bytes(S.workbook({"s": [[k, "a"], [None, "b"]] if k else []}))
    S.register(spark)
    rows = spark.read.format("sheets").option("path", f"file://{tmp_path}").load()
    assert rows.rdd.getNumPartitions() == 1 and rows.count() == 38
    assert sorted(r.cells[0] for r in rows.filter("row = 1").collect()) == sorted(str(k) for k in range(1, 20))
    monkeypatch.setattr(S, "BYTES", 2000)
    assert [x for p in S.SheetsReader(f"file://{tmp_path}").partitions() for x in p.places] == sorted(f"{tmp_path}/{k:02d}.xlsx" for k in range(20))
    assert len(S.SheetsReader(f"file://{tmp_path}").partitions()) > 5
    # A long sheet is read row by row, a short one at once: the same rows.
    whole = list(S.sheet_rows(tmp_path / "07.xlsx"))
    monkeypatch.setattr(S, "PIECE", 0)
    assert list(S.sheet_rows(tmp_path / "07.xlsx")) == whole == [("s", 1, ["7", "a"]), ("s", 2, [None, "b"])]
