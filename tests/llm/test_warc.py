
import hashlib
import io
import random

from corpuskit.llm import warc
from corpuskit.llm._shared import new_path


def brute(rows):
    payloads = [(k, (h or "").encode()) for k, h in rows]
    out = []
    for k, p in payloads:
        same = [x for x, q in payloads if q == p and x is not None]
        first = min(same) if len(p) >= 100 and same and k is not None else k
        out.append((k, len(p), hashlib.sha256(p).hexdigest(), "revisit" if first != k else "response", first if first != k else None))
    return sorted(out, key=str)


def read(spark, rows, split):
    df = spark.createDataFrame([(k, f"http://x/{k} y\n", h, "e") for k, h in rows], "page_id long, url string, html string, digest string").repartition(3)
    archives = warc.write_warc(df, new_path(spark, "warc"))
    got = warc.read_warc(spark, archives, split_bytes=split)
    out = [(None if r.record_id.endswith("null") else int(r.record_id[9:]), r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to_id[9:]) if r.refers_to_id else None) for r in got.collect()]
    return sorted(out, key=str)


def test_round_trip_over_any_split(spark):
    rnd = random.Random(4)
    noise = ["".join(chr(rnd.randrange(32, 2000)) for _ in range(rnd.randrange(0, 4000))) for _ in range(40)]
    rows = [(i, rnd.choice(noise)) for i in range(120)] + [(200, None), (201, ""), (202, "short"), (203, "short"), (None, noise[0] * 2), (None, noise[0] * 2), (204, "x" * 300_000), (205, "x" * 300_000), (5, rnd.choice(noise))]
    want = brute(rows)
    for split in (997, 20_000, 1 << 22):
        assert read(spark, rows, split) == want, split


def test_empty(spark):
    assert read(spark, [(1, "a")], 100)[0][0] == 1
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(spark, warc.write_warc(df, new_path(spark, "warc"))).count() == 0


def test_archive_inside_a_payload_is_not_taken_for_records():
    inner = warc.record("urn:page:9", None, b"inner", "0", None, "2000-01-01T00:00:00Z") + b"tail"
    noise = random.Random(1).randbytes(70_000)
    parts = [warc.record("urn:page:1", "u", noise + inner + noise, "0", None, "d"), warc.record("urn:page:2", "u", b"p", "0", None, "d")]
    data = b"".join(parts)
    for split in (64, 1000, 10**6):
        found = [h["warc-record-id"] for low in range(0, len(data), split) for _, h, _ in warc.records(warc.Source(io.BytesIO(data), len(data)), low, min(low + split, len(data)))]
        assert found == ["<urn:page:1>", "<urn:page:2>"]

