import hashlib
import random

import pyarrow.fs as pafs

from cratewise.llm import warc


def rows():
    rng = random.Random(6)
    long = ["<p>" + "x" * 1200, "é" * 500, "a\r\n\r\nb: c\r\n" * 200, "y" * 998 + "€"]
    out = [(i, f"http://e/{i}\r\nX: 1", rng.choice([*long, f"<p>{i}</p>", "", "short", "y" * 999])) for i in range(200)]
    return [*out, (300, None, None), (301, "u", long[0]), (301, "v", long[0]), (None, "w", long[0]), (None, "w", "z" * 2000), (None, "w", "z" * 2000), (302, "big", "<b>" * 300_000)]


def brute(data):
    last = {}
    for page_id, _, html in data:
        h = (html or "").encode()
        if len(h) >= 1000:
            last.setdefault(h, []).append(page_id)
    out = []
    for page_id, url, html in data:
        h = (html or "").encode()
        ids = [x for x in last.get(h, []) if x is not None]
        top = max(ids) if ids and len(last[h]) > 1 else None
        revisit = top is not None and page_id != top
        out.append((page_id, url, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", top if revisit else None, b"" if revisit else h))
    return sorted(out, key=repr)


def test_round_trip(spark, shared, tmp_path):
    data = rows()
    pages = spark.createDataFrame([(*r, 1, "f") for r in data], "page_id bigint, url string, html string, offset int, file string").repartition(3)
    index = warc.write_archives(pages, str(tmp_path))
    got = [(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in warc.read_records(index, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == brute(data)
    some = warc.read_records(index.where("page_id % 7 = 0"), str(tmp_path)).collect()
    assert sorted(r["page_id"] for r in some) == sorted([i for i in range(0, 200, 7)] + [301, 301])
    size = {f.base_name: f.size for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(str(tmp_path)))}
    spans = sorted((r["file"], r["offset"], r["length"]) for r in index.collect())
    for (f, o, n), (g, p, _) in zip(spans, spans[1:]):
        assert (p == o + n) if f == g else (p == 0 and o + n == size[f])


def test_ranges_merge_neighbours():
    rows = [{"file": "a", "offset": o, "length": 10} for o in (0, 10, 50, 200_000)] + [{"file": "b", "offset": 0, "length": warc.STRETCH_BYTES + 5}, {"file": "b", "offset": warc.STRETCH_BYTES + 5, "length": 1}]
    got = [(f, b, e, len(p)) for f, b, e, p in warc.ranges(iter(rows))]
    assert got == [("a", 0, 60, 3), ("a", 200_000, 200_010, 1), ("b", 0, warc.STRETCH_BYTES + 5, 1), ("b", warc.STRETCH_BYTES + 5, warc.STRETCH_BYTES + 6, 1)]


def test_empty_table(spark, shared):
    assert warc.archive(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []
