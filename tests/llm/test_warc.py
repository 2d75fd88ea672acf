import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from sluice.llm.warc import _gzip, read_archives, record, salvage, write_archives

PAGES = "page_id long, url string, html string, payload string, record_type string, _digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", None, "y") for i, u, h in rows], PAGES)


def archive(n, packed):
    rng = random.Random(1)
    parts = [record("response", k, f"http://h/{k}", bytes(rng.randrange(32, 127) for _ in range(400 + k)), None) for k in range(n)]
    return [_gzip(p) if packed else p for p in parts]


def read(data):
    return list(salvage(io.BytesIO(data), len(data)))


@pytest.mark.parametrize("packed", [True, False])
def test_whole_archive(packed):
    found = read(b"".join(archive(20, packed)))
    assert [r["source_id"] for r in found] == [str(k) for k in range(20)]
    assert all(r["kind"] == "record" for r in found)
    assert found[3]["payload_digest"] == hashlib.sha1(found[3]["payload"]).hexdigest()


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("harm", ["flip", "cut", "noise", "lost header", "false magic"])
def test_salvage(packed, harm):
    parts = archive(20, packed)
    bad = parts[7]
    middle = len(bad) // 2
    parts[7] = {
        "flip": bad[:middle] + bytes([bad[middle] ^ 0x55]) + bad[middle + 1 :],
        "cut": bad[:middle],
        "noise": bytes(random.Random(2).randrange(256) for _ in range(5000)),
        "lost header": bad[60:],
        "false magic": b"\x1f\x8b\x08 WARC/1.1\r\n" * 5 + bad[:20],
    }[harm]
    data = b"".join(parts)
    found = read(data)
    good = [r["source_id"] for r in found if r["kind"] == "record"]
    assert good == [str(k) for k in range(20) if k != 7]
    gaps = [r for r in found if r["kind"] == "gap"]
    assert gaps and all(g["reason"] for g in gaps)
    # Records and gaps cover the file, in order, without overlaps.
    assert [found[0]["start"], *[r["end"] for r in found]] == [0, *[r["start"] for r in found[1:]], len(data)]


@pytest.mark.parametrize("packed", [True, False])
def test_damage_at_both_ends(packed):
    parts = archive(5, packed)
    found = read(b"junk" + b"".join(parts) + parts[0][:50])
    assert [r["kind"] for r in found] == ["gap", *["record"] * 5, "gap"]
    assert read(b"") == [] and [r["kind"] for r in read(b"only junk")] == ["gap"]


def test_a_member_is_plain_gzip():
    data = gzip.decompress(_gzip(record("response", None, None, b"", None)))
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_round_trip_with_copies(spark):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "u", big), (5, "u", big), (3, None, big), (2, "u", other), (4, "u", "small"), (6, "u", "small"), (7, "u", None), (None, "u", other), (8, 'q"\r\n', "")]
    manifest = write_archives(pages(spark, rows))
    out = read_archives(manifest).collect()
    assert all(r["kind"] == "record" for r in out) and len(out) == len(rows)
    got = {r["source_id"]: r for r in out}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items() if r["record_type"] == "revisit"} == {"1": ("revisit", "5"), "3": ("revisit", "5"), None: ("revisit", "2")}
    for i, u, h in rows:
        r, full = got[None if i is None else str(i)], (h or "").encode()
        assert (r["payload_bytes"], r["payload_digest"], r["uri"]) == (len(full), hashlib.sha1(full).hexdigest(), u or "")
        assert r["payload"] == (None if r["record_type"] == "revisit" else full)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)


def test_archives_turn_over_and_empty_table(spark):
    manifest = write_archives(pages(spark, [(k, "u", "y" * 50) for k in range(40)]), archive_bytes=3000)
    assert manifest.count() > 4 and read_archives(manifest).count() == 40
    assert read_archives(write_archives(pages(spark, []))).count() == 0


def test_other_readers_can_follow_revisits(spark, tmp_path):
    """Standard headers only: a revisit names the record and address that it repeats, and each archive itself."""
    rows = [(1, "http://h/a b", "z" * 2000), (9, "http://h/é", "z" * 2000), (3, "http://h/c", "small")]
    manifest = write_archives(pages(spark, rows), folder=tmp_path.as_uri())
    heads = {}
    for file in tmp_path.iterdir():
        for part in gzip.decompress(file.read_bytes()).split(b"WARC/1.1\r\n")[1:]:
            fields = dict(line.split(": ", 1) for line in part.split(b"\r\n\r\n")[0].decode("ascii").split("\r\n"))
            heads[fields["WARC-Record-ID"]] = fields
    kinds = sorted(f["WARC-Type"] for f in heads.values())
    assert kinds == ["response", "response", "revisit", *["warcinfo"] * manifest.count()]
    revisit = next(f for f in heads.values() if f["WARC-Type"] == "revisit")
    first = heads[revisit["WARC-Refers-To"]]
    assert revisit["WARC-Target-URI"] == "http://h/a%20b" and first["WARC-Target-URI"] == revisit["WARC-Refers-To-Target-URI"] == "http://h/%C3%A9"
    assert first["WARC-Payload-Digest"] == revisit["WARC-Payload-Digest"]
    assert read_archives(manifest, info=True).filter("kind = 'info'").count() == manifest.count()


def test_damaged_archives_of_a_table(spark, tmp_path):
    """Bytes of written archives are damaged; all other records come back, and the gaps are told."""
    rows = [(k, f"http://h/{k}", f"page {k} " * 40) for k in range(60)]
    write_archives(pages(spark, rows), folder=tmp_path.as_uri(), archive_bytes=2000)
    files = sorted(tmp_path.iterdir())
    assert len(files) > 3
    for n, file in enumerate(files):
        data = bytearray(file.read_bytes())
        if n % 2:
            data[len(data) // 2] ^= 0xFF
        file.write_bytes(bytes(data) + (b"noise" if n % 3 == 0 else b""))
    found = read_archives(spark.createDataFrame([(f.as_uri(),) for f in files] + [(None,)], "file string")).collect()
    good = {int(r["source_id"]) for r in found if r["kind"] == "record"}
    gaps = [r for r in found if r["kind"] == "gap"]
    assert len(good) >= 60 - len(files) // 2 and all(r["reason"] and r["end"] > r["start"] for r in gaps)
    assert {r["file"] for r in gaps} == {f.as_uri() for n, f in enumerate(files) if n % 2 or n % 3 == 0}


def test_clashing_columns_and_a_very_long_page(spark):
    long = "wide page " * 2_000_000
    df = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, None, None)], "page_id long, url string, html string")
    for name in ("payload", "_digest", "_first", "refers_to", "uri", "source_id", "record_type", "file"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    got = {r["source_id"]: (r["record_type"], r["payload_bytes"]) for r in read_archives(write_archives(df)).select("source_id", "record_type", "payload_bytes").collect()}
    assert got == {"1": ("revisit", len(long)), "2": ("response", len(long)), "3": ("response", 0)}
