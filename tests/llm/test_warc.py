"""Archives that are broken in any way are read to their end; other writers' revisits; large files part by part."""

import gzip
import random
import tracemalloc

import pytest

from colloquy.llm import warc


def record(kind, body, **more):
    fields = {"WARC-Type": kind, "Content-Length": len(body)} | {k.replace("_", "-"): v for k, v in more.items()}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode() + body + b"\r\n\r\n"


def page(text):
    return b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(text)


@pytest.mark.parametrize("bad", [b"1\r\nA\r\n-6\r\n", b"-1\r\n", b"+2\r\nab\r\n0\r\n\r\n", b"0x2\r\nab\r\n0\r\n\r\n", b"1_0\r\n", b"\r\n\r\n", b"f" * 40 + b"\r\n", b"5"])
def test_sizes_that_are_no_hex_digits_end_in_an_error(bad):
    with pytest.raises(ValueError):
        warc.dechunked(bad)
    assert warc.dechunked(b"2 ;x=1\r\nab\r\n0\r\n\r\n") == b"ab"


def test_records_are_the_same_however_the_parts_are_cut():
    r = random.Random(2)
    raw = record("response", page(b"x" * 5_000), X_Page_Id=1) + b"junk\r\n\r\n" + record("resource", b"WARC/ \r\n\r\nWARC/", X_Page_Id=2) + b"WARC/1.0\r\nContent-Length: 9999999\r\nWARC-Type: x\r\n\r\nshort\r\n\r\n" + record("response", b"", X_Page_Id=3) + b"tail"
    want = list(warc.parse([raw]))
    assert [f.get("x-page-id") for f, _ in want if f] == ["1", "2", "3"] and len(want) == 6
    for _ in range(60):
        cuts = sorted({0, len(raw), *(r.randrange(len(raw)) for _ in range(r.randrange(40)))})
        assert list(warc.parse(raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False))) == want


def test_changed_bytes_never_stop_a_reader(spark, tmp_path):
    r = random.Random(9)
    whole = [record("response", page(b"abc" * 200), X_Page_Id=7, WARC_Record_ID="<urn:a>", WARC_Payload_Digest="sha1:00"), record("revisit", b"", X_Page_Id=8, WARC_Refers_To="<urn:a>"), *(x + b"\r\n\r\n" for x in warc.records(5, "u", "y" * 300, None, "0", 100))]
    bits = [b"-6", b"\r\n", b"x", b"\x00", b"99999999999999999999", b":", b"WARC/", b"\xff", b"-1", b""]
    sure = 0
    for n in range(20):
        out, before = [], False
        for _ in range(500):
            chosen, changes = r.choice(whole), r.randrange(4)
            raw = bytearray(chosen)
            sure += before and not changes and chosen is whole[1]  # after a whole record, a whole revisit is found whatever comes later
            before = not changes
            for _ in range(changes):
                at = r.randrange(len(raw))
                raw[at : at + r.randrange(4)] = r.choice(bits)
            out.append(bytes(raw))
        (tmp_path / f"{n}.warc").write_bytes(b"".join(out))
        packed = bytearray(gzip.compress(b"".join(out[:20])))
        packed[r.randrange(len(packed))] ^= 255
        (tmp_path / f"{n}.warc.gz").write_bytes(bytes(packed))
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    assert sum(x.page_id == 8 and x.refers_to == 7 for x in rows) >= sure > 80 and sum(x.error is not None for x in rows) > 500


def test_numbers_and_references_of_other_writers(spark, tmp_path):
    uuid = "<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>"
    parts = [record("response", page(b"one"), X_Page_Id=1, WARC_Record_ID=uuid), record("revisit", b"", X_Page_Id=2, WARC_Refers_To=uuid), record("revisit", b"", X_Page_Id=3, WARC_Refers_To="<urn:uuid:5>"), record("revisit", b"", X_Page_Id=4, WARC_Refers_To="<urn:page:-77>")]
    parts += [record("response", page(b"x"), X_Page_Id=bad) for bad in ("abc", "9" * 30, "1.5")] + [record("response", b"x", X_Page_Id=9, WARC_Segment_Number="x"), record("continuation", b"x", WARC_Segment_Total_Length="y", WARC_Segment_Number=2)]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    assert {(r.page_id, r.refers_to) for r in rows if r.error is None} == {(1, None), (2, 1), (3, None), (4, -77)}
    assert sum("no number" in (r.error or "") for r in rows) == 5


def test_a_file_is_held_record_by_record():
    raw = gzip.compress(b"".join(record("resource", bytes(200_000), X_Page_Id=i) for i in range(300)))
    tracemalloc.start()
    assert sum(len(block) for _, block in warc.parse(warc.members(raw))) == 60_000_000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8_000_000
