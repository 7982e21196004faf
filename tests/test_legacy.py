"""Legacy database files and paged sources."""

import json
import sqlite3

from lodestrand.sources import legacy


def test_sqlite_files_with_drifting_columns(spark, tmp_path):
    for k, ddl in enumerate(("a TEXT, b INTEGER", "a TEXT", "z TEXT")):
        con = sqlite3.connect(tmp_path / f"{k}.db")
        con.execute(f"CREATE TABLE {'findings' if k < 2 else 'other'} ({ddl})")
        con.execute(f"INSERT INTO {'findings' if k < 2 else 'other'} VALUES ({','.join('?' * (2 if k == 0 else 1))})", ("x", 5)[: 2 if k == 0 else 1])
        con.commit()
        con.close()
    got = legacy.read_sqlite(spark, [str(tmp_path / f"{k}.db") for k in range(3)], "findings", "a string, b long").collect()
    assert sorted((r["path"][-4:], r["a"], r["b"]) for r in got) == [("0.db", "x", 5), ("1.db", "x", None)]


def test_pages_stop_at_the_watermark(tmp_path):
    pages = [[{"id": 1, "updated_at": "2024-03"}, {"id": 2}], [{"id": 3, "updated_at": "2024-01"}], [{"id": 4, "updated_at": "2024-05"}]]
    for k, rows in enumerate(pages, 1):
        (tmp_path / f"page-{k}.json").write_text(json.dumps(rows))
    fetch = legacy.page_file(str(tmp_path))
    assert [r["id"] for r in legacy.pages_until(fetch, "2024-02")] == [1, 2]
    assert [r["id"] for r in legacy.pages_until(fetch, None)] == [1, 2, 3, 4]


def test_process_table(spark, tmp_path):
    from lodestrand.sources import legacy

    for pid, words in (("12", b"python\x00-m\x00run\x00"), ("7", b""), ("self", b"x\x00"), ("30", b"bash\x00-c\x00a b\nc\x00")):
        (tmp_path / pid).mkdir()
        (tmp_path / pid / "cmdline").write_bytes(words)
    got = {r["pid"]: r["args"] for r in legacy.read_processes(spark, f"file://{tmp_path}").collect()}
    assert got == {12: ["python", "-m", "run"], 30: ["bash", "-c", "a b\nc"]}
    assert [r["pid"] for r in legacy.read_processes(spark, f"file://{tmp_path}", "^python").collect()] == [12]
