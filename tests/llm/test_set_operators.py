"""Line dedup, n-gram join, embeddings, WARC, token counts, quality: against brute force, round trips and planted cases."""

import hashlib
import random

import numpy as np
import pytest

from braidline.llm import line_dedup
from braidline.llm import ngram_join as ngram_module
from braidline.llm import quality as quality_module
from braidline.llm.common import shared_path
from braidline.llm.components import components
from braidline.llm.embedding_dups import audited_beam, embedding_dups, unit
from braidline.llm.hnsw import Graph
from braidline.llm.line_dedup import dedup_lines, line_verdicts
from braidline.llm.ngram_join import bands, linked, ngram_join, signatures
from braidline.llm.quality import BUCKETS, packed, score_quality, unpacked
from braidline.llm.queries import op5_token_counts, public_file
from braidline.llm.token_counts import TokenRollup, count_tokens
from braidline.llm.warc import BundleWriter, archive, make_record, read_bundles, read_record, record_id, seek_table, write_bundles

DOCS = "doc_id long, text string, line string, n string, c string"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "a", "b", "c") for k, t in enumerate(texts)], DOCS)


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 140)]
    want = roots(200, pairs)
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: want[k] for p in pairs for k in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(4)
    for n in (1, 5, 9, 10, 11, 19, 20, 40, 95, 200, 1000):
        for _ in range(30):
            a = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
            b = a.copy()
            for _ in range(rng.integers(0, max(1, n // 10) + 2)):
                if rng.random() < 0.5 and len(b) > 1:
                    b = np.delete(b, rng.integers(len(b)))
                else:
                    b = np.append(b, rng.integers(1, 2**63, dtype=np.uint64))
            b = np.unique(b)
            if linked(a, b, 9, 10):
                assert np.intersect1d(signatures(a, 9, 10), signatures(b, 9, 10)).size
    for num, den in ((9, 10), (4, 5)):
        for n in range(1, 16):  # small sets leave pieces empty
            for _ in range(40):
                a = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
                b = np.unique(np.append(a[: len(a) - int(rng.integers(0, 2))], rng.integers(1, 2**63, rng.integers(0, 3), dtype=np.uint64)))
                if linked(a, b, num, den):
                    assert np.intersect1d(signatures(a, num, den), signatures(b, num, den)).size
    one = [signatures(np.array([k], np.uint64), 9, 10) for k in range(1, 400)]
    assert len(np.unique(np.concatenate(one))) == sum(map(len, one))
    low = 1
    for first, last in bands(5000, 9, 10):
        assert first == low and last >= first
        low = last + 1


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def test_ngram_join(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", "a b", "A  b", "a b c", " ", "one"]
    base = [rng.choices(words, k=rng.choice([12, 40, 120, 300])) for _ in range(6)]
    for b in base:
        for _ in range(14):
            t = list(b)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [texts[10]] * 5
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = roots(len(texts), pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs(spark, texts)).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in range(len(texts))}
    assert ngram_join(docs(spark, [])).count() == 0


def test_rows_without_id(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "x"])
    line, like = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine other"
    texts = [(None, " ".join(base)), (1, " ".join(base)), (2, near), (None, "alone here at last"), (None, line), (3, line), (4, like), (5, line)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join(df).collect())
    assert [c for d, c in got if d] == [1, 1, 3, 4, 3] and [c for d, c in got if not d] == [0, 1, 3]
    removed = {(r.doc_id, r.n_removed) for r in line_verdicts(df).collect()}
    assert removed == {(None, 0), (1, 0), (2, 1), (3, 0), (4, 1), (5, 1)}


def test_line_dedup(spark):
    rng = random.Random(6)
    words = [f"v{k}" for k in range(300)]
    texts = [None, "", "\n\n", "few words\nfew words"]
    lines = [rng.choices(words, k=rng.choice([1, 4, 5, 6, 10, 25, 70, 140])) for _ in range(25)]
    for _ in range(40):
        got = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(lines))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = rng.choice(words)
            got.append("  ".join(line).upper() if rng.random() < 0.3 else " ".join(line))
        texts.append("\n".join(got))
    flat = [(d, n, set(x.lower().split())) for d, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"))]
    gone = {(d, n) for k, (d, n, s) in enumerate(flat) if s and any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in flat[:k])}
    got = {r.doc_id: r for r in line_verdicts(docs(spark, texts)).collect()}
    assert {(d, int(n)) for d, r in got.items() for n in r.removed.split(",") if n} == gone
    cleaned = {r.doc_id: r.text for r in dedup_lines(docs(spark, texts)).collect()}
    for d, t in enumerate(texts):
        assert cleaned[d] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone))
    assert line_verdicts(docs(spark, [])).count() == 0


def test_lines_whose_parity_map_is_dense_are_told_apart_by_wide_maps(spark, monkeypatch):
    """Random lines of many words from a small vocabulary: they share words of their prefixes, and 64 bits of parity say
    little; of all that meet, few are similar, and nothing is lost."""
    rng = random.Random(11)
    words = [f"v{k}" for k in range(500)]
    lines = [rng.sample(words, k=rng.randint(130, 180)) for _ in range(150)]
    lines += [[*x[: len(x) - 12], *rng.sample(words, k=12)] for x in lines[:10]]
    met, settled = [], line_dedup.settle

    def settle(df, tag):
        out = settled(df, tag)
        if tag == "met":
            met.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "settle", settle)
    got = {r.doc_id: r.n_removed for r in line_verdicts(docs(spark, [" ".join(x) for x in lines])).collect()}
    sets = [set(x) for x in lines]
    want = {k: int(any(5 * len(x & y) >= 4 * len(x | y) for y in sets[:k])) for k, x in enumerate(sets)}
    assert got == want and sum(want.values()) >= 5
    assert sum(met) < 200, met


def variants(count: int) -> list[set[str]]:
    """Versions of a few long lines, some pairs of which are just similar, some just not."""
    rng = random.Random(12)
    words = [f"v{k}" for k in range(4000)]
    bases, made = [rng.sample(words, k=90) for _ in range(4)], []
    for k in range(4 * count):
        line = list(bases[k % 4])
        for at in rng.sample(range(90), k=5):
            line[at] = rng.choice(words)
        made.append(set(line))
    return made


def test_most_versions_of_a_line_are_beaten_before_classes_are_joined(spark, monkeypatch):
    """Their rarest words are what sets them apart, so leaders are found by other words of their prefixes, too."""
    sets, met, settled = variants(120), [], line_dedup.settle

    def settle(df, tag):
        out = settled(df, tag)
        if tag == "met":
            met.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "settle", settle)
    got = {r.doc_id: r.n_removed for r in line_verdicts(docs(spark, [" ".join(sorted(x)) for x in sets])).collect()}
    assert got == {k: int(any(5 * len(x & y) >= 4 * len(x | y) for y in sets[:k])) for k, x in enumerate(sets)}
    assert sum(met) < 40_000, met


def test_sets_of_very_different_sizes_meet_in_their_bands(spark):
    """A set and the largest or smallest one that is similar to it, whichever comes first; one word more is too many."""
    lines, want = [], []
    for size in (4, 5, 8, 20, 45, 55, 56, 64, 100, 255, 256, 320, 500):
        most = size * 5 // 4
        for pair, similar in (((size, most), True), ((most, size), True), ((size, most + 1), False), ((most + 1, size), False)):
            lines += [" ".join(f"v{len(want)}x{k}" for k in range(n)) for n in pair]
            want += [0, int(similar)]
    assert [r.n_removed for r in line_verdicts(docs(spark, lines)).orderBy("doc_id").collect()] == want


def test_operators_leave_small_tables_behind(spark, tmp_path, monkeypatch):
    """What an operator writes on its way goes before its rows are read: only its answer stays on disk."""
    made, forgotten = {}, set()
    for module in (line_dedup, ngram_module, quality_module):
        settled, forgot = module.settle, module.forget

        def settle(df, tag, settled=settled):
            out = settled(df, tag)
            made[out._braidline_path] = tag
            return out

        def forget(*frames, forgot=forgot):
            forgotten.update(getattr(f, "_braidline_path", None) for f in frames)
            forgot(*frames)

        monkeypatch.setattr(module, "settle", settle)
        monkeypatch.setattr(module, "forget", forget)
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dedup_lines(texts).count()
    ngram_join(texts).count()
    score_quality(texts, spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).count()
    assert sorted(tag for path, tag in made.items() if path not in forgotten) == ["gone", "joined", "scores"]


def test_long_lines_that_share_few_rare_words_are_not_candidates(spark, monkeypatch):
    """Random long lines, whose parity maps say nothing, with one similar pair: of all pairs only that one is verified."""
    rng = random.Random(9)
    words = [f"v{k}" for k in range(2000)]
    lines = [rng.sample(words, k=rng.randint(150, 300)) for _ in range(120)]
    lines.append([*lines[7][:-9], *rng.sample(words, k=9)])
    seen = []

    def beaten(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    verified = line_dedup._beaten
    monkeypatch.setattr(line_dedup, "_beaten", beaten)
    got = {r.doc_id: r.n_removed for r in line_verdicts(docs(spark, [" ".join(x) for x in lines])).collect()}
    sets = [set(x) for x in lines]
    assert got == {k: int(any(5 * len(s & o) >= 4 * len(s | o) for o in sets[:k])) for k, s in enumerate(sets)}
    assert sum(got.values()) == 1 and sum(seen) < 60


def test_embedding_dups(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = [list(map(float, centres[rng.integers(12)] + rng.normal(scale=s, size=16))) for s in rng.choice([0.05, 0.3, 1.5], 300)]
    x += [x[0]] * 5 + [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, x[1][:8], []]
    df = spark.createDataFrame([(k, v, "label") for k, v in enumerate(x)], "vec_id long, embedding array<double>, rep string")
    good = [k for k, v in enumerate(x) if v and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    u = np.array([x[k] for k in good])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    pairs = [(good[a], good[b]) for a, b in zip(*np.nonzero(u @ u.T >= 0.9), strict=True) if a != b]
    want = roots(len(x), pairs)
    got = {r.vec_id: r for r in embedding_dups(df, shards=3, block=64).collect()}
    assert len(got) == len(x)
    for k in range(len(x)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (sum(a == k for a, _ in pairs), want[k], want[k] == k)
    assert embedding_dups(df.limit(0)).count() == 0


def test_audit_leaves_self_matches_out():
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(1000, 16)))
    x[500:510] = unit(x[:10] + 0.01 * rng.normal(size=(10, 16)))

    class Narrow:
        """Finds a vector itself, and others only with a beam of 90 and more."""

        def search(self, q, beam):
            sims = q @ x.T
            sims[(sims < 1 - 1e-9) & (beam < 90)] = -1
            ids = np.argsort(-sims, axis=1)[:, :beam]
            return ids, np.take_along_axis(sims, ids, 1)

    assert audited_beam(Narrow(), x, 0.95, 48, 0.97, 64, unit(x[:10] + 0.01 * rng.normal(size=(10, 16)))) == 96
    assert audited_beam(Narrow(), x, 0.95, 48, 0.97, 64, x[:0]) == 96


def test_embedding_dups_in_shards_that_are_not_scanned(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1600, 16))
    x[1500:] = x[:100] + rng.normal(scale=0.2, size=(100, 16))  # few links
    u = unit(x)
    want = ((u @ u.T >= 0.9).sum(1) - 1).tolist()
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dups(df, shards=2).collect()}
    assert sum(want) > 100 and [got[k] for k in range(len(x))] == want


def test_graph_recall():
    x = np.random.default_rng(3).normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = Graph(x).search(x[:200], 96)
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), best.tolist(), strict=True)]) >= 0.9


def test_seekable_bundle():
    import zstandard

    writer = BundleWriter(frame=200)
    records = [make_record(k, f"http://h/{k}\n", b"p%d" % k * 50, "d", None if k % 2 else 0) for k in range(9)]
    for r in records:
        writer.add(r)
    bundle = writer.finish()
    places = seek_table(bundle)
    assert len(places) > 3 and zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read() == b"".join(records)
    head, _ = read_record(bundle, places[0][0], places[0][1], 0)
    assert head["X-Page"] == "0" and head["WARC-Type"] == "revisit"


def test_archive(spark):
    big = "<p>" + "x" * 200
    html = [big, None, "", big, "short", "short", "é" * 60, "é" * 60, big + "\r\n\r\nWARC/1.1"]
    pages = spark.createDataFrame([(k + 5, None if k == 3 else f"http://h/{k}", t, "x", "y") for k, t in enumerate(html)], "page_id long, url string, html string, page string, digest string")
    got = {r.page: r for r in archive(pages).collect()}
    first: dict = {}
    for k, t in enumerate(html):
        raw = (t or "").encode()
        first.setdefault(raw, k + 5)
        r, revisit = got[k + 5], len(raw) >= 100 and first[raw] != k + 5
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[raw] if revisit else None)
    assert archive(pages.limit(0)).count() == 0


def test_archive_of_pages_without_or_with_repeated_ids(spark):
    big = "x" * 200
    pages = spark.createDataFrame([(None, "u", big), (None, None, big), (7, "u", big), (7, "v", big), (9, "w", big), (None, None, None)], "page_id long, url string, html string")
    got = archive(pages).collect()
    assert sorted((r.page or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0)] * 3 + [(7, "response", 0)] * 2 + [(9, "revisit", 7)]
    assert len({r.record_id for r in got if r.page is None}) == 3 and all(r.record_id == record_id(r.page) for r in got if r.page is not None)


def test_records_are_found_by_their_place(spark):
    pages = spark.range(300).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(cast(id as string), 400) as html")
    path = shared_path(spark, "test-warc")
    write_bundles(pages.repartition(3), path, bundle=4000)
    places = read_bundles(spark, path).collect()
    files = {r.path: r.content for r in spark.read.format("binaryFile").load(path).collect()}
    assert len(places) == 300 and len(files) > 3
    for r in places[::17]:
        head, block = read_record(files[r.bundle], r.frame_offset, r.frame_size, r.record_offset)
        assert head["X-Page"] == str(r.page) and block.endswith(str(r.page).encode() * 400)


def test_rollup(spark):
    rollup = TokenRollup(spark, shared_path(spark, "test-rollup"))
    shape = "op string, doc string, source string, lang string, tokenizer string, tokens long"
    events = lambda *rows: spark.createDataFrame(list(rows), shape)
    totals = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert totals() == {}
    first = events(("insert", "1", "a", "en", "v1", 10), ("insert", "2", "a", None, "v1", 5), ("insert", "1", "a", "en", "v2", 7), ("insert", "1", "a", "en", "v1", 9), (None, "9", "a", "en", "v1", 1))
    assert rollup.commit("1", first) and totals() == {("a", "en", "v1"): (1, 10), ("a", None, "v1"): (1, 5), ("a", "en", "v2"): (1, 7)}
    assert not rollup.commit("1", first) and len(totals()) == 3
    rollup.commit("2", events(("revise", "1", None, None, "v1", 12), ("revise", "8", None, None, "v1", 1), ("insert", "2", "a", None, "v1", 50)))
    assert totals()[("a", "en", "v1")] == (1, 12) and totals()[("a", None, "v1")] == (1, 5)
    rollup.commit("3", events(("delete", "1", None, None, None, 0), ("delete", "2", None, None, "v9", 0)))
    assert totals() == {("a", None, "v1"): (1, 5)}
    rollup.commit("4", events(("insert", "1", "b", "en", "v1", 3)))
    assert totals() == {("a", None, "v1"): (1, 5), ("b", "en", "v1"): (1, 3)}


def applied(held, batch):
    """The rollup's rule, by document and tokenizer: deletes, then inserts, then revisions."""
    doc_of = {d for op, d, *_ in batch if d is not None}
    cut = {(d, t) for op, d, _, _, t, _ in batch if op == "delete"}
    keys = {(d, t) for _, d, _, _, t, _ in batch} | {k for k in held if k[0] in doc_of}
    for key in keys:
        if key[0] is None:
            continue
        if key in cut or (key[0], None) in cut:
            held.pop(key, None)
        put = [(n or 0, s or "", s, lang) for op, d, s, lang, t, n in batch if op == "insert" and (d, t) == key]
        if put and key not in held:
            n, _, s, lang = max(put, key=lambda x: x[0])
            held[key] = (s, lang, n)
        revised = [n or 0 for op, d, _, _, t, n in batch if op == "revise" and (d, t) == key]
        if revised and key in held:
            held[key] = (*held[key][:2], max(revised))
    return held


def test_rollup_against_brute_force(spark):
    rng = random.Random(12)
    rollup = TokenRollup(spark, shared_path(spark, "test-rollup"), compact_every=3)
    held: dict = {}
    for turn in range(7):
        batch = []
        for _ in range(rng.randint(0, 40)):
            doc = rng.choice([*"abcdefgh", None])
            # of several inserts the largest counts; where counts are equal so are the rest
            n = rng.choice([None, 1, 5, 9, 20])
            batch.append((rng.choice(["insert", "insert", "delete", "revise", "other"]), doc, f"s{n}", "en" if n else None, rng.choice(["v1", "v2", None]), n))
        events = spark.createDataFrame(batch, "op string, doc string, source string, lang string, tokenizer string, tokens long")
        name = f"2026/{turn} = ü"
        assert rollup.commit(name, events) and not rollup.commit(name, events)
        applied(held, batch)
        want: dict = {}
        for (_, t), (s, lang, n) in held.items():
            docs_, tokens = want.get((s, lang, t), (0, 0))
            want[s, lang, t] = (docs_ + 1, tokens + n)
        assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == want
    assert rollup._base()[0] is not None and len(rollup.committed()) == 7


def plain_counts(texts):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_file("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    code = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [len(code.encode_ordinary(t or "")) for t in texts]


def test_count_tokens(spark):
    texts = [None, "", "two words", "日本 🙂\n\n  x", "a" * 3000]
    got = {r.id: r.tokens for r in count_tokens(docs(spark, texts), public_file("byte_bpe_50k.tiktoken")).collect()}
    assert [got[k] for k in range(len(texts))] == plain_counts(texts)
    assert count_tokens(docs(spark, []), public_file("byte_bpe_50k.tiktoken")).count() == 0


def test_token_counts_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want, seen = {}, set()
    for r, n in zip(rows, plain_counts([r.text for r in rows]), strict=True):
        if (r.text or "") not in seen:
            seen.add(r.text or "")
            docs_, tokens = want.get((r.source, r.lang), (0, 0))
            want[r.source, r.lang] = (docs_ + 1, tokens + n)
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in op5_token_counts(spark, "/root/testdata/sf0.001").collect()} == want


def test_traits_are_packed_and_unpacked():
    rng = np.random.default_rng(2)
    lists = [np.unique(rng.integers(0, BUCKETS, n)) for n in (0, 1, 2, 3, 500, 0, 4, 1)] + [np.array([0, BUCKETS - 1]), np.array([65535, 131070])]
    rows = unpacked([packed(x.astype(np.int32)) for x in lists])
    assert [rows.index[a:b].tolist() for a, b in zip(rows.start, rows.start[1:], strict=False)] == [x.tolist() for x in lists]
    assert len(unpacked([])) == 0


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = labels.where("doc_id % 4 <> 1")
    return score_quality(docs.withColumn("p_low", docs.lang), known).join(labels.where("doc_id % 4 = 1"), "doc_id").collect()


def test_quality_held_out(judged):
    low = [(r.p_low >= 0.5) == (r.quality == 0) for r in judged]
    assert np.mean(low) >= 0.98
    clean = [r for r in judged if r.quality == 1 and r.toxic == 0]
    assert np.mean([not r.rejected for r in clean]) >= 0.98
    toxic = [r for r in judged if r.toxic == 1]
    assert np.mean([r.rejected for r in toxic]) >= 0.7


def test_quality_odd_inputs(spark):
    shape = "doc_id long, text string, lang string, source string, p_toxic string"
    rows = spark.createDataFrame([(1, None, None, None, "x"), (2, "", "en", "s", "x"), (2, "a b", "en", "s", "x")], shape)
    none = spark.createDataFrame([(1, None, 1)], "doc_id long, quality int, toxic int")
    got = score_quality(rows, none).collect()
    assert len(got) == 3 and not any(r.rejected for r in got)
    assert score_quality(rows.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert score_quality(rows, one).count() == 3
