import base64
import gzip
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from tierlabel.llm.warc import Salvage, packed, read_archives, record_bytes, write_archives

PAGES = T.StructType([T.StructField(c, t) for c, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("own", T.StringType()), ("digest", T.StringType()))])


def salvage(data):
    return list(Salvage(lambda at, n: data[at : at + n], len(data)))


def good(data):
    return [r.headers["warc-record-id"] for _, _, records, _ in salvage(data) for r in records]


def check_cover(data):
    """Stretches and gaps follow each other and cover the file."""
    at = 0
    for offset, length, records, reason in salvage(data):
        assert offset == at and length > 0 and bool(records) != bool(reason)
        at += length
    assert at == len(data)


@pytest.fixture(scope="module")
def members():
    r = random.Random(1)
    plain = [record_bytes(i, f"http://x/{i}\r\n", bytes(r.randrange(256) for _ in range(r.randrange(400))), None, "2020") for i in range(12)]
    return [p if i % 3 == 0 else packed(p) for i, p in enumerate(plain)]


def test_clean_file(members):
    assert good(b"".join(members)) == [f"<urn:page:{i}>" for i in range(12)]


@pytest.mark.parametrize("seed", range(40))
def test_damage_costs_only_what_it_hits(members, seed):
    r = random.Random(seed)
    data, starts = b"".join(members), [sum(map(len, members[:i])) for i in range(12)]
    kind, at = r.choice(["flip", "cut", "noise", "end"]), r.randrange(len(data))
    hit = max(i for i, s in enumerate(starts) if s <= at)
    if kind == "flip":
        data = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
    elif kind == "cut":
        end = min(starts[hit] + len(members[hit]), at + 9)
        data = data[:at] + data[end:]
    elif kind == "noise":
        at = starts[hit]
        data = data[:at] + b"\x1f\x8b\x08noise WARC/1.1\r\n" + data[at:]
    else:
        data = data[:at]
    want = [f"<urn:page:{i}>" for i in range(12) if kind == "noise" or (i != hit if kind != "end" else i < hit)]
    check_cover(data)
    found = good(data)
    assert [x for x in found if x != f"<urn:page:{hit}>"] == [x for x in want if x != f"<urn:page:{hit}>"]
    if kind == "noise":
        assert found == want


def texts(n, r, size=400):
    """Records of a text that packs well, so that damage does not stop the unpacking at once."""
    return [record_bytes(i, f"http://x/{i}", " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(size))).encode(), None, "2020") for i in range(n)]


def ids(numbers):
    return [f"<urn:page:{i}>" for i in numbers]


@pytest.mark.parametrize("bad", [0, 1, 3])
def test_bad_record_inside_a_member_is_a_gap_in_unpacked_bytes(bad):
    records = texts(4, random.Random(3))
    spoiled = list(records)
    spoiled[bad] = records[bad][:-6] + bytes([records[bad][-6] ^ 1]) + records[bad][-5:]
    data = packed(b"".join(records[:2])) + packed(b"".join(spoiled)) + packed(records[0])
    assert good(data) == ids([0, 1]) + ids(i for i in range(4) if i != bad) + ids([0])
    gaps = [s for s in Salvage(lambda at, n: data[at : at + n], len(data)).stretches() if s.record is None]
    assert [(s.reason, s.inner_offset, s.inner_length) for s in gaps] == [("block digest", sum(map(len, records[:bad])), len(records[bad]))]
    inside = [s for s in Salvage(lambda at, n: data[at : at + n], len(data)).stretches() if s.offset == gaps[0].offset]
    assert sum(s.inner_length for s in inside) == sum(map(len, spoiled))


@pytest.mark.parametrize("seed", range(60))
def test_whole_file_member_with_a_broken_byte(seed):
    r = random.Random(seed)
    records = texts(30, r)
    whole = packed(b"".join(records))
    at = r.randrange(10, len(whole))
    data = whole[:at] + bytes([whole[at] ^ (1 << r.randrange(8))]) + whole[at + 1 :] + packed(record_bytes(99, "u", b"after", None, "2020"))
    sound = len(zlib.decompressobj(31).decompress(whole[: at - 1]))  # bytes that surely come out before the damage
    before = sum(sum(map(len, records[: i + 1])) <= sound for i in range(30))
    found = good(data)
    assert found[:before] == ids(range(before)) and found[-1] == "<urn:page:99>" and len(set(found)) == len(found)
    assert any(reason for *_, reason in salvage(data))
    for *_, kept, _ in salvage(data):
        for x in kept:
            i = int(x.headers["warc-record-id"][10:-1])
            assert i == 99 or records[i].endswith(x.block + b"\r\n\r\n")


def test_damage_that_does_not_stop_the_unpacking_costs_one_record():
    """A literal byte changes in place: the checksum of the member fails, every other record is there."""
    records = texts(5, random.Random(8))
    raw = zlib.compressobj(0, zlib.DEFLATED, 31)
    whole = bytearray(raw.compress(b"".join(records)) + raw.flush())
    whole[whole.index(records[2][-40:])] ^= 1
    assert good(bytes(whole)) == ids([0, 1, 3, 4])
    reasons = [reason for *_, reason in salvage(bytes(whole)) if reason]
    assert reasons == ["block digest", "member checksum"]


def test_records_without_digest_count_only_in_sound_members():
    plain = re.sub(rb"WARC-(Block|Payload)-Digest:.*\r\n", b"", record_bytes(1, "u", b"text", None, "2020"))
    whole = packed(plain * 3)
    assert len(good(whole)) == 3 and good(whole[:-1] + b"\x77") == []


def test_large_members_are_read_in_pieces():
    r = random.Random(4)
    records = [record_bytes(i, "u", r.randbytes(700_000), None, "2020") for i in range(30)]
    named = gzip.compress(b"".join(records), 1)
    named = named[:3] + b"\x08" + named[4:10] + b"file.warc\0" + named[10:]
    largest = 0

    def read(at, n):
        nonlocal largest
        largest = max(largest, n)
        return named[at : at + n]

    found = list(Salvage(read, len(named)).stretches())
    assert [s.record.headers["warc-record-id"] for s in found] == ids(range(30)) and largest <= 1 << 20
    cut = named[: len(named) // 2]
    found = good(cut)
    assert found == ids(range(len(found))) and 13 <= len(found) <= 15


def test_noise_only():
    assert salvage(b"") == [] and [x[1] for x in salvage(b"no archive at all" * 99)] == [17 * 99]


def test_round_trip_with_edges(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\r\nX: y", None), (4, "v", ""), (9, "w", "<p>é</p>")]
    rows += [(None, "n", "alone"), (None, "n", "<p>é</p>"), (6, "d", "twice"), (6, "d", "twice"), (10, "long", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*x, "q", "q") for x in rows], PAGES).repartition(3)
    files = write_archives(pages, file_bytes=2000)
    out = read_archives(spark, files).collect()
    assert len(out) == len(rows) and all(x["gap"] is None for x in out)
    payloads = {}
    for i, _, html in rows:
        payloads.setdefault(i, []).append((html or "").encode())
    for x in out:
        name = x["record_id"][10:-1]
        own = payloads[None if name == "none" else int(name)]
        assert x["payload_bytes"] in {len(p) for p in own}
        assert x["payload_digest"] in {base64.b32encode(hashlib.sha1(p).digest()).decode() for p in own}
    kinds = {(x["record_id"], x["record_type"], x["refers_to"]) for x in out if x["payload_bytes"] == 9}
    assert kinds == {
        ("<urn:page:9>", "response", None),
        *((f"<urn:page:{i}>", "revisit", "<urn:page:9>") for i in (1, 2, "none")),
    }
    assert read_archives(spark, write_archives(spark.createDataFrame([], PAGES))).collect() == []
