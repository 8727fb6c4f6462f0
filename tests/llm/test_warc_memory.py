"""Archives are written and read back in small batches, however long the pages are."""

from quarry.llm import warc


def _largest_batches(monkeypatch, df, counted):
    """Has mapInArrow note the largest batch that a worker gets and the largest that it gives, in files of the folder."""
    kept = type(df).mapInArrow

    def mapped(self, run, *rest, **named):
        def watched(batches):
            import uuid

            def got():
                for batch in batches:
                    with open(f"{counted}/in-{uuid.uuid4().hex}", "w") as file:
                        file.write(str(batch.nbytes))
                    yield batch

            for batch in run(got()):
                with open(f"{counted}/out-{uuid.uuid4().hex}", "w") as file:
                    file.write(str(batch.nbytes))
                yield batch

        return kept(self, watched, *rest, **named)

    monkeypatch.setattr(type(df), "mapInArrow", mapped)
    return lambda kind: max(int(p.read_text()) for p in counted.glob(f"{kind}-*"))


def test_long_pages_pass_in_batches_of_bounded_bytes(spark, tmp_path, monkeypatch):
    (counted := tmp_path / "counted").mkdir()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    pages = spark.range(0, 3000, 1, 1).selectExpr("id AS page_id", "'u' AS url", "concat(id, repeat('long', 2500)) AS html").union(spark.createDataFrame([(-1, "u", None)], "page_id long, url string, html string")).coalesce(1)
    largest = _largest_batches(monkeypatch, pages, counted)
    made = warc.read_pages(warc.write_archives(pages, f"file://{tmp_path}/w")).select("page_id", "payload_bytes", "record_type").collect()
    assert sorted(map(tuple, made)) == sorted([(-1, 0, "response"), *((i, 10000 + len(str(i)), "response") for i in range(3000))])
    assert largest("in") < 5 << 20
    assert largest("out") < 1 << 20  # lengths leave the worker, payloads do not
    assert spark.conf.get(name, None) == before


def test_payloads_are_read_if_asked(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "é1"), (2, "u", "é1"), (3, "u", "")], "page_id long, url string, html string")
    listed = warc.write_archives(pages, f"file://{tmp_path}/w")
    order = lambda payloads: sorted((r.record_id, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(listed, payloads).collect())
    assert order(True) == [("<urn:page:1>", 3, "é1".encode()), ("<urn:page:2>", 0, b""), ("<urn:page:3>", 0, b"")]
    assert [x[:2] + (None,) for x in order(True)] == order(False)
