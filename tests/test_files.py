"""Reading and writing files, and notes indexed as a stream."""

import gzip

from pyspark.sql import functions as F

from chartloom.functions import coerce
from chartloom.sources import readers, writers
from chartloom.streaming import indexing


def test_csv(spark, tmp_path):
    with gzip.open(tmp_path / "patients.csv.gz", "wt") as f:
        f.write('subject_id,anchor_age,note\n1,40.0,"two\nlines, and ""quotes"""\n2,x,\n2,50,again\n,1,none\n9,7,out\n')
    (tmp_path / "patients.csv").write_text("subject_id\n5\n")
    path = readers.find_file(spark, str(tmp_path), "patients")
    assert path.endswith("patients.csv.gz") and readers.find_file(spark, str(tmp_path), "nothing") is None
    raw = readers.read_csv(spark, path).collect()
    assert len(raw) == 5 and raw[0].note == 'two\nlines, and "quotes"' and raw[1].note == ""
    cohort = spark.createDataFrame([(1,), (2,)], "subject_id int")
    columns = {"subject_id": coerce.safe_int, "anchor_age": coerce.safe_int, "note": None, "absent": None}
    df = readers.load_table(spark, str(tmp_path), "patients", columns, cohort, "subject_id")
    assert sorted((r.subject_id, r.anchor_age, r.absent) for r in df.collect()) == [(1, 40, None), (2, None, None)]
    assert readers.load_table(spark, str(tmp_path), "nothing", columns, required=False) is None
    status = {r.name: r.found for r in readers.data_status(spark, str(tmp_path), ("patients", "nothing")).collect()}
    assert status == {"patients": True, "nothing": False}


def test_dictionary_notes_and_lists(spark, tmp_path):
    (tmp_path / "d_labitems_v2.csv").write_text("ITEMID,Label\n5,Potassium\nx,Bad\n")
    assert [tuple(r) for r in readers.load_dictionary(spark, str(tmp_path)).collect()] == [(5, "Potassium", None, None)]
    deep = tmp_path / "more" / "hosp"
    deep.mkdir(parents=True)
    (deep / "d_labitems.csv").write_text("itemid,label\n6,Sodium\n")
    assert [r.itemid for r in readers.load_dictionary(spark, str(tmp_path / "more")).collect()] == [6]
    for kind in ("discharge", "radiology"):
        (tmp_path / f"{kind}.csv").write_text("note_id,subject_id,hadm_id,charttime,storetime,text\n" + "".join(f'{kind}{i},1,2,,,"a\nb"\n' for i in range(3)))
    notes = readers.load_notes(spark, str(tmp_path), limit_per_kind=2)
    assert notes.count() == 4 and {r.note_type for r in notes.collect()} == {"discharge", "radiology"}
    (tmp_path / "ids.txt").write_text("1\nx\n 22 \n\n")
    assert [r.id for r in readers.read_ids(spark, str(tmp_path / "ids.txt")).collect()] == [1, 22]
    (tmp_path / "q.txt").write_text("why?\n\n  how?  \n")
    assert [r.question for r in readers.read_questions(spark, str(tmp_path / "q.txt")).collect()] == ["why?", "how?"]
    (tmp_path / "pool.json").write_text('{"_meta": {"pool_k": 10},\n "queries": [{"query_id": "a", "query": "x"}, {"query_id": "b", "query": "y"}]}')
    assert {r.query_id for r in readers.read_pool(spark, str(tmp_path / "pool.json")).collect()} == {"a", "b"}
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.read_json_lines(spark, str(tmp_path / "rows.jsonl"), "a int").agg(F.sum("a")).first()[0] == 3
    (tmp_path / "guide one.html").write_text("<html><script>x()</script><p>Page one</p>\f<p>  </p>\f<p>Page three</p></html>")
    pages = readers.read_pages(spark, str(tmp_path)).orderBy("page").collect()
    assert [(p.page, p.text) for p in pages] == [(1, "Page one"), (3, "Page three")]
    assert readers.read_pages(spark, str(tmp_path), spark.createDataFrame([(pages[0].source_file,)], "source_file string")).count() == 0


def test_writing(spark, tmp_path):
    path, log = str(tmp_path / "t"), str(tmp_path / "log")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, note_type string")
    writers.reload_table(df, path)
    writers.reload_table(df, path)
    assert spark.read.parquet(path).count() == 2
    parts = str(tmp_path / "parts")
    writers.reload_table(df, parts, ["note_type"])
    writers.replace_partitions(spark.createDataFrame([(7, "a"), (8, "a")], "id int, note_type string"), parts)
    assert sorted(r.id for r in spark.read.parquet(parts).collect()) == [2, 7, 8]
    assert writers.load_logged(spark, log, "t", "x.csv", lambda: df, path) == 2
    try:
        writers.load_logged(spark, log, "t", "x.csv", lambda: spark.read.parquet(str(tmp_path / "absent")), path)
    except Exception:  # noqa: BLE001
        pass
    assert sorted((r.status, r.rows_loaded) for r in spark.read.parquet(log).collect()) == [("failed", 0), ("ok", 2)]
    status = {r.table_name: r.n for r in writers.table_status(spark, {"t": path, "u": str(tmp_path / "absent")}).collect()}
    assert status == {"t": 2, "u": -1}
    writers.export_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    writers.export_text(df, "note_type", str(tmp_path / "text"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == ["a", "b"]
    assert writers.verify_tokens(spark.createDataFrame([(["a"],), ([],)], "tokens array<string>")).first().ratio == 0.5
    assert [r.t for r in writers.fill_where_null(spark.createDataFrame([(None,), ("x",)], "t string"), "t", F.lit("y")).collect()] == ["y", "x"]


def test_stream(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    notes = spark.createDataFrame([(i, f"HISTORY: note {i} was written. ") for i in range(5)], "note_id bigint, text string")
    notes.write.parquet(source)
    for extra in (None, 9):
        if extra:
            spark.createDataFrame([(0, "again"), (extra, "PLAN: new note.")], "note_id bigint, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("note_id bigint, text string").parquet(source)
        indexing.stream_index(stream, index, str(tmp_path / "checkpoint")).awaitTermination()
    out = spark.read.parquet(index)
    assert sorted({r.note_id for r in out.collect()}) == [0, 1, 2, 3, 4, 9] and out.where("note_id = 0").count() == 1
    assert len(out.first().embedding) == 64
