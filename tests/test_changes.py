import random

from quillon.streaming.changes import apply_changes, compact, current

SCHEMA = "generation int, seq long, kind string, document_id long, title string, text string, extra string"


def brute(rows):
    newest = {}
    for g, s, kind, doc, title, text, _ in rows:
        k = (kind or "").strip().upper()
        if doc is None or k not in ("ADD", "0", "DELETE", "1"):
            continue
        place = (-1 if g is None else g, -1 if s is None else s, k in ("DELETE", "1"))
        if doc not in newest or place > newest[doc][0]:
            newest[doc] = (place, g, s, title or "", text or "")
    return {(d, g, s, t, x) for d, (p, g, s, t, x) in newest.items() if not p[2]}


def test_any_order_repeats_and_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for g in (1, 2):
        for s in range(40):
            doc = rng.choice([7, 7, 7, *range(12), None])
            kind = rng.choice(["ADD", "add", " 0", "DELETE", "1", "Add", "noise", None])
            rows.append((g, s, kind, doc, rng.choice([None, "t"]), f"{g}-{s}", "x"))
    shuffled = rows + rng.sample(rows, 20)
    rng.shuffle(shuffled)
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    for part in (shuffled[:30], shuffled[30:60]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(log)
    apply_changes(spark, log, out, files_per_batch=1)
    half = {tuple(r) for r in current(spark, out).collect()}
    assert half == brute(shuffled[:60])
    spark.createDataFrame(shuffled[60:], SCHEMA).coalesce(1).write.mode("append").parquet(log)
    versions = apply_changes(spark, log, out, files_per_batch=1)
    assert {tuple(r) for r in current(spark, versions).collect()} == brute(shuffled)
    # once more: nothing new, the same table
    assert {tuple(r) for r in current(spark, apply_changes(spark, log, out)).collect()} == brute(shuffled)


def test_empty_log(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "log"))
    assert current(spark, apply_changes(spark, str(tmp_path / "log"), str(tmp_path / "out"))).count() == 0


def test_only_changes_are_written_and_versions_are_compacted(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    add = lambda seq, doc, text, kind="ADD": (1, seq, kind, doc, "t", text, "x")

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(log)
        apply_changes(spark, log, out, files_per_batch=1, batches=3)

    def batch(number):
        return {r["document_id"] for r in spark.read.parquet(f"{out}/versions/batch={number}").collect()}

    run([add(1, 1, "a"), add(2, 2, "b"), add(3, 3, "c")])
    assert batch(0) == {1, 2, 3}
    run([add(1, 1, "a"), add(5, 2, "", "DELETE"), add(2, 2, "b")])  # repeated, newer, late
    assert batch(1) == {2}
    run([add(2, 2, "b"), add(3, 3, "c")])  # nothing new
    assert batch(2) == set()
    assert {(r["document_id"], r["seq"]) for r in current(spark, out).collect()} == {(1, 1), (3, 3)}
    run([add(4, 2, "late"), add(9, 3, "new")])  # older than the tombstone, newer than the text
    assert not (tmp_path / "out" / "versions" / "batch=0").exists()
    assert [p.name for p in (tmp_path / "out" / "bases").iterdir() if p.name.startswith("base")] == ["base=3"]
    assert {(r["document_id"], r["seq"], r["text"]) for r in current(spark, out).collect()} == {(1, 1, "a"), (3, 9, "new")}
    run([add(8, 3, "late"), add(10, 2, "back")])  # the state outlives the compaction
    assert batch(4) == {2}
    assert {(r["document_id"], r["seq"]) for r in current(spark, out).collect()} == {(1, 1), (2, 10), (3, 9)}
    compact(spark, out)
    assert {(r["document_id"], r["seq"]) for r in current(spark, out).collect()} == {(1, 1), (2, 10), (3, 9)}
