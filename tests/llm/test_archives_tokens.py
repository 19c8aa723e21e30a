"""Archives, token files and packing: round trips and brute force."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from playtrail.llm import capture_index, files, packing, queries, token_store, tokens
from tests.llm.helpers import DOCS, PROSE, SF, crc_of, odd_documents, sorted_rows, token_ids


def plain_records(pages):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of (page_id, url, html) rows."""
    first = {}
    for p, _, html in pages:
        if p is not None:
            first[html or ""] = max(p, first.get(html or "", p))
    out = []
    for p, _, html in pages:
        data = (html or "").encode()
        to = first.get(html or "") if len(data) >= 1000 else None
        to = None if to == p else to
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


def test_capture_query(spark):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted_rows(queries.QUERIES["op6_capture_index"](spark, SF)) == plain_records(pages)


def odd_pages():
    big = "x" * 1000
    return [
        (1, "http://a.example/1", big), (2, "http://b.example/", big), (3, None, big), (3, None, big), (None, "http://c.example", big),
        (4, "", ""), (5, None, None), (6, "http://a.example/1", "y" * 999), (7, "http://a.example/1", "y" * 999), (8, "no url\r\nX: 1", "<p>ü\n\t中</p>"),
        (9, "http://[bad", "q"), (10, "HTTPS://WWW.Example.org:443/a b?x=1#f", "q"), (None, None, None), (11, "http://a.example/1", PROSE * 4000), (None, None, "z" * 2000), (None, None, "z" * 2000),
    ]


def test_capture_of_odd_rows(spark):
    pages = spark.createDataFrame(odd_pages(), "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("key", F.lit(1))
    assert sorted_rows(capture_index.archive_and_read_back(pages)) == plain_records(odd_pages())
    assert capture_index.archive_and_read_back(pages.limit(0)).count() == 0


def test_a_changed_payload_is_an_error(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<p>one</p>" * 50)], "page_id bigint, url string, html string")
    (place,) = capture_index.write_archives(pages).collect()
    system, path = files.open_folder(place["archive"])
    record = gzip.decompress(system.open_input_file(path).read_at(place["length"], place["offset"]))
    assert capture_index.parse_record(record)["payload_bytes"] == 500
    with pytest.raises(ValueError, match="payload"):
        capture_index.parse_record(record.replace(b"one", b"two", 1))


def test_lookup_of_hot_and_missing_keys(spark):
    rows = [(i, "http://hot.example/" if i % 3 == 0 else f"http://h{i % 50}.example/{i}", f"page {i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    captures = capture_index.write_archives(pages, archive_bytes=5000)
    bounds = capture_index.write_index(captures, lines=7)
    asked = ["http://hot.example", "https://www.h1.example/1", "http://none.example/", "http://a.example/", "http://zzz.example/"]
    keys = capture_index.keys_of(spark.createDataFrame([(a,) for a in [*asked, *asked]], "url string"))
    got = capture_index.fetch(capture_index.locate(keys, bounds), payload=True).collect()
    assert Counter(r["page_id"] for r in got) == Counter([i for i in range(600) if i % 3 == 0] + [1])
    assert all(r["payload"].decode() == f"page {r['page_id']}" for r in got)


def test_archives_are_plain_gzip_members(spark):
    pages = spark.createDataFrame(odd_pages()[:3], "page_id bigint, url string, html string").coalesce(1)
    archive = capture_index.write_archives(pages).first()["archive"]
    data = gzip.decompress(open(archive.removeprefix("file:"), "rb").read())
    assert data.count(b"WARC/1.1\r\n") == 3 and data.count(b"WARC-Type: revisit") == 2


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.b.a.org/x?q=1#f", "org,a,b)/x?q=1"), ("https://A.org:443", "org,a)/"), ("http://a.org:8080/", "org,a:8080)/"), (None, ""), ("", ""),
        ("not a url", "not%20a%20url"), ("http://a.org/\r\nx", "org,a)/x"),
    ],
)
def test_keys(url, key):
    assert capture_index.capture_key(url) == key


@pytest.mark.parametrize("remembered", [3, 500, 10**6])
def test_encoder_matches_the_library(remembered):
    rng = random.Random(4)
    texts = [r[1] or "" for r in odd_documents() if len(r[1] or "") < 10_000]
    alphabet = ["a", "B", "é", "ß", "中", "🙂", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'", "'LL", ".", ",", "!!", "$$$", "1", "½", "_", "-", "the", " dog", "\r\n", "<|endoftext|>", "́", "’"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    # The same unit at a text's end, before a space, and before another white space.
    texts += [f"a {u}{end}" for u in ("the\n", "the", "\n", "the\t", "x,") for end in ("", " dog", "  dog", "\ndog", " \n dog")]
    rng.shuffle(texts)
    encode = tokens.Encoder(tokens.public_vocabulary(), remembered)
    for _ in range(2):
        got = encode.encode(texts)
        assert all(len(m) <= remembered for m in (encode.first, encode.rest, encode.odd))
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == token_ids(text)[:-1], repr(text)


def plain_store(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start, out = 0, []
    for d, text in order:
        ids = token_ids(text)
        out.append((d, start, len(ids), crc_of(ids)))
        start += len(ids)
    return out


def test_token_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted_rows(queries.QUERIES["op9_addressable_tokens"](spark, SF)) == plain_store(docs)


def test_tokens_of_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame(odd_documents(), DOCS).withColumn("part", F.lit(1)).withColumn("start", F.lit("x"))
    got = sorted_rows(token_store.read_tokens(token_store.write_tokens(docs)))
    want = plain_store([r[:2] for r in odd_documents()])
    # Rows without an id come first in either order.
    assert [r for r in got if r[0] is not None] == [r for r in want if r[0] is not None]
    assert Counter((r[2], r[3]) for r in got) == Counter((r[2], r[3]) for r in want)
    assert token_store.read_tokens(token_store.write_tokens(docs.limit(0))).count() == 0


@pytest.mark.parametrize("high", [1, 256, 257, 60_000, 70_000, 2**32])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_segment_round_trip(high, n):
    ids = np.random.default_rng(n).integers(0, high, n).astype(np.uint32)
    segment = token_store.Segment(token_store.encode_segment(ids))
    assert (segment.all() == ids).all()
    for i in [*range(min(n, 20)), *range(max(0, n - 20), n)]:
        assert segment.one(i) == ids[i]


def test_any_token_is_addressable(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT", 1000)
    rng, writer, docs = np.random.default_rng(1), token_store.Writer(str(tmp_path)), {}
    for d in (7, None, 3, 5, 2):
        docs[d] = rng.integers(0, 60_000, int(rng.integers(0, 2500))).astype("<u4")
        writer.add(d, docs[d].tobytes())
    writer.close()
    reader, whole = token_store.Reader(writer.name), np.concatenate(list(docs.values()))
    assert [reader.token(i) for i in range(0, len(whole), 37)] == whole[::37].tolist()
    for d, _, n, pieces in reader.documents():
        assert n == len(docs[d]) and (np.concatenate([*pieces, np.zeros(0, "<u4")]) == docs[d]).all()


def plain_best_two_fit(counts, capacity):
    """One sequence after the other, on the list of lengths."""
    left, bins = Counter(counts), []
    while left:
        held, gap = [], capacity
        for n in sorted(left, reverse=True):
            while left[n] and n <= gap:
                held.append(n)
                left[n] -= 1
                gap -= n
        left += Counter()
        if gap and len(held) > 1:
            room = gap + held[-1]
            pairs = [(a + b, a, b) for a in left for b in left if b <= a and a + b <= room and (a != b or left[a] > 1)]
            best = max(pairs, default=(0, 0, 0))
            if best[0] > held[-1]:
                left[held.pop()] += 1
                for n in best[1:]:
                    held.append(n)
                    left[n] -= 1
                left += Counter()
        bins.append(held)
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_best_two_fit_matches_one_by_one(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([10, 17, 50, 100]))
    counts = Counter(rng.integers(1, capacity + 1, int(rng.integers(1, 400))).tolist())
    if seed % 2:
        counts = Counter({n: c * 20 for n, c in counts.items() if rng.random() < 0.5})
    got = [sum(p.values()) and sorted(Counter(p).elements()) for p, times in packing.best_two_fit(dict(counts), capacity) for _ in range(times)]
    fill = lambda bins: sorted(sum(b) for b in bins)
    want = plain_best_two_fit(counts, capacity)
    assert len(got) == len(want) and sum((Counter(b) for b in got), Counter()) == counts
    assert fill(got) == fill(want)


def check_packing(rows, docs, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for d, own in by_doc.items():
        ids = token_ids(docs[d])
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert len(own) == -(-len(ids) // capacity) and all(r["length"] == capacity for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == crc_of(ids[r["start"] : r["start"] + r["length"]])
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packing_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_best_two_fit"](spark, SF).collect()
    n = check_packing(rows, docs, 1024)
    assert n <= 1.01 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_packing_of_odd_rows(spark):
    unique = {r[0]: r for r in odd_documents()}
    docs = spark.createDataFrame(list(unique.values()), DOCS).withColumn("lo", F.lit("x")).withColumn("length", F.lit("x"))
    check_packing(packing.pack_documents(docs, 64).collect(), {d: r[1] for d, r in unique.items()}, 64)
    everything = spark.createDataFrame(odd_documents(), DOCS)
    packed = packing.pack(packing.pieces_of(everything, 64, keep_ids=True).withColumn("lo", F.lit(1)), 64)
    own = packing.sequences(packed)
    total = sum(len(token_ids(r[1])) for r in odd_documents())
    sizes = [len(r["ids"]) // 4 for r in own.collect()]
    assert sum(sizes) == total and max(sizes) <= 64 and len(sizes) <= 1.1 * total / 64 + 2
    assert packing.pack_documents(docs.limit(0)).count() == 0
