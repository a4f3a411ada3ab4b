"""The incremental pull: each page once, in batches, from its offset on."""

import json

from coverlake.sources import pull


def page(folder, moment, *ids, text=None):
    (folder / f"{moment}.json").write_text(
        text if text is not None
        else json.dumps([{"external_id": i, "created_at": moment, "title": f"T {i}", "extra": [1], "url": None} for i in ids])
    )


def test_pull(spark, tmp_path):
    pull.register(spark)
    landed = tmp_path / "landed"
    landed.mkdir()
    got = []

    def run(name="c", **options):
        stream = spark.readStream.format("landed_pages").option("path", str(landed)).options(**options).load()
        q = stream.writeStream.foreachBatch(
            lambda b, n: got.append(sorted(r["external_id"] for r in b.collect()))
        ).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        out = [x for x in got if x]
        got.clear()
        return sorted(sum(out, []))

    assert run() == []
    page(landed, "20240101T000000", "1", "2")
    page(landed, "20240102T000000", "3")
    (landed / "notes.txt").write_text("no page")
    assert run() == ["1", "2", "3"]
    assert run() == []  # nothing new
    page(landed, "20240103T000000", "4")
    page(landed, "20240104T000000", text="{}")
    page(landed, "20240105T000000", text='["x", {"external_id": 5}]')
    assert run() == ["4", "5"]
    assert run("other", after="20240102T000000") == ["4", "5"]
    whole = spark.read.format("landed_pages").option("path", f"file://{landed}").load()
    assert sorted((r["external_id"], r["page"][:8], r["title"]) for r in whole.collect()) == [
        ("1", "20240101", "T 1"), ("2", "20240101", "T 2"), ("3", "20240102", "T 3"), ("4", "20240103", "T 4"), ("5", "20240105", None)
    ]
    assert spark.read.format("landed_pages").option("path", str(tmp_path / "none")).load().count() == 0
