from factloom.sources import files
from factloom.streaming import incremental


def test_each_file_once(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v int")
    source, sink, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    rows((1, 1), (2, 1)).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    incremental.ingest(spark, source, schema, sink, log, ["k"]).awaitTermination()
    rows((3, 1)).coalesce(1).write.mode("append").parquet(source)
    incremental.ingest(spark, source, schema, sink, log, ["k"]).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_newest_wins(spark, tmp_path):
    source, state, log = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "log")
    for n, rows in enumerate([[(1, 5), (2, 5)], [(1, 4), (2, 6), (3, 1)]]):
        spark.createDataFrame(rows, "k int, v int").coalesce(1).write.mode("append").parquet(source)
        incremental.upsert_stream(spark, source, spark.read.parquet(source).schema, state, log, ["k"], "v").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{state}/v1").collect())) == [(1, 5), (2, 6), (3, 1)]


def test_readers(spark, tmp_path):
    (tmp_path / "CIK0000000001.json").write_text('{"cik": "1", "filings": {"recent": {"accessionNumber": ["0001-22-000003"], "filingDate": ["2022-01-02"], "form": ["S-3"], "fileNumber": ["333-1"], "primaryDocument": ["a.htm"], "primaryDocDescription": ["d"]}}}')
    from factloom.operators.predicates import submissions

    read = files.read_submissions(spark, str(tmp_path / "CIK0000000001.json"))
    row = submissions(read, "cik", "filings.recent", "https://example.org/data/").first()
    assert (row.accn, row.form_type, row.url) == ("000122000003", "S-3", "https://example.org/data/0000000001/000122000003/a.htm")
    index = tmp_path / "idx"
    index.mkdir()
    (index / "77.csv").write_text("form_type,file_number,file_path,filing_date\nS-3,333-1,a\\b.htm,2020-01-02\nS-3/A,333-1,a\\c.htm,2020-02-02\n")
    by = files.index_by_file_number(files.read_index(spark, str(index))).first()
    assert (by.cik, [f.file_path for f in by.files]) == ("77", ["a/b.htm", "a/c.htm"])
    docs = files.read_documents(spark, str(index), "*.csv").first()
    assert docs.extension == ".csv"
    assert files.run_sql_file(spark, "select 1 as a;\nselect 2 as a;\n").first().a == 2
    assert files.read_sql(spark, "select :x as a", {"x": 3}).first().a == 3
