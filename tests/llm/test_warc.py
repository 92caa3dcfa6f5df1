import base64
import hashlib
import io
from collections import Counter

import pytest
import zstandard

from strataloom.llm import common, warc
from strataloom.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, bundle string, frame string, __sum string"


def rows():
    made = [(i, f"http://h{i % 5}.example/{i}", f"<p>{i % 17}</p>" * (i % 40)) for i in range(120)]
    made += [(200, None, None), (201, "http://x/\r\ny", ""), (None, "http://n/", "<p>3</p>" * 3), (202, "u", "é" * 400_000), made[5], made[5]]
    return [(*r, "b", "f", "s") for r in made]


def expected(found):
    first = {}
    for i, _, h, *_ in found:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = Counter()
    for i, _, h, *_ in found:
        data = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and i != f
        out[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None)] += 1
    return out


def write(spark, name):
    folder = f"{shared_dir(spark)}/{name}"
    return warc.write_bundles(spark.createDataFrame(rows(), SCHEMA), folder), folder


def test_records_come_back(spark):
    index, folder = write(spark, "warc-a")
    got = warc.read_records(index, folder, True).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows())
    texts = {i: (h or "").encode() for i, _, h, *_ in rows()}
    assert all(r.payload == (texts[r.page_id] if r.record_type == "response" else b"") for r in got)


def test_bundles_are_plain_zstandard_and_frames_stand_alone(spark):
    index, folder = write(spark, "warc-b")
    places = index.collect()
    for name in {r.bundle for r in places}:
        data = open(f"{folder.removeprefix('file://')}/{name}", "rb").read()
        whole = b"".join(iter(lambda s=zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True): s.read(1 << 20), b""))
        assert whole.count(b"WARC/1.1\r\n") == sum(r.bundle == name for r in places)

        class Source(io.BytesIO):
            def size(self):
                return len(self.getvalue())

        reader = warc.BundleReader(Source(data))
        assert b"".join(reader.frame(k) for k in range(len(reader.sizes))) == whole
        for r in places:
            if r.bundle == name:
                assert reader.frame(r.frame)[r.offset : r.offset + r.length].startswith(b"WARC/1.1\r\n")


def test_smaller_payloads_are_all_responses(spark):
    folder = f"{shared_dir(spark)}/warc-c"
    index = warc.write_bundles(spark.createDataFrame(rows(), SCHEMA), folder, min_bytes=1 << 30)
    assert {r.record_type for r in warc.read_records(index, folder).collect()} == {"response"}


def test_no_rows(spark):
    folder = f"{shared_dir(spark)}/warc-d"
    assert warc.read_records(warc.write_bundles(spark.createDataFrame([], SCHEMA), folder), folder).count() == 0


@pytest.mark.parametrize("most", [20_000, 0])
def test_one_payload_holds_most_pages(spark, monkeypatch, most):
    """Broadcast, and dealt over salts."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    found = [(i, f"http://h/{i}", None if i % 9 == 0 else "" if i % 5 else f"<p>{i % 30}</p>", "b", "f", "s") for i in range(3000)] + [(None, "u", "", "b", "f", "s")] * 50
    folder = f"{shared_dir(spark)}/warc-most-{most}"
    index = warc.write_bundles(spark.createDataFrame(found, SCHEMA), folder)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index, folder).collect())
    assert got == expected(found)
