"""The operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, jaccard_join, language_id, mixing, ppm_scoring, sentencepiece_codec, substring_dedup, token_counts, topk_search, zip_warc
from sparkloom.llm._common import BATCH_BYTES, drop_rows, pick

W = [f"w{i}" for i in range(400)]
ROWS = [
    (1, " ".join(W[:120])),
    (2, " ".join(W[:120])),
    (2, " ".join(W[:120])),
    (3, " ".join(W[:118] + ["x", "y"])),
    (4, None),
    (5, ""),
    (6, "  \n "),
    (7, "Short Text"),
    (8, "short text"),
    (9, " ".join(W[200:260] * 40)),
    (10, " ".join(["pre"] + W[30:90] + ["post"])),
    (None, " ".join(W[:120])),
    (11, " ".join(W[:60] + ["q"] + W[60:120])),
]


def by_id(df, *names):
    return sorted((tuple(r[n] for n in ("doc_id", *names)) for r in df.collect()), key=str)


def test_columns_are_picked_by_exact_name(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, DOC_ID long")
    assert pick(df, "doc_id", "text").collect() == [(1, "a")]
    with pytest.raises(ValueError):
        pick(df, "lang")
    rows = spark.createDataFrame([(1, "A", 2), (1, "b", 2), (None, "c", 2), (3, None, 2)], df.schema)
    left = lambda gone, same=None: sorted(r["text"] or "" for r in drop_rows(rows, gone, same).collect())
    assert drop_rows(rows, spark.createDataFrame([(1,)], "doc_id long")).columns == ["doc_id", "text", "DOC_ID"]
    assert left(spark.createDataFrame([(1,)], "doc_id long")) == ["", "c"]
    assert left(spark.createDataFrame([(None,)], "doc_id long")) == ["", "A", "b"]
    digest = lambda t: hashlib.sha256(t).hexdigest()[:32]
    assert left(spark.createDataFrame([(1, digest(b"a")), (3, digest(b""))], "doc_id long, d string"), "d") == ["b", "c"]


@pytest.mark.parametrize("hot", [1000, 1])
def test_exact_dedup(docs_of, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    got = by_id(exact_dedup.exact_groups(docs_of(ROWS)), "keep_id", "group_size", "kept")
    want = []
    norm = lambda t: (t or "").encode().lower()
    for i, t in ROWS:
        same = [j for j, u in ROWS if norm(u) == norm(t)]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep))
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_groups(docs_of([])).count() == 0


def test_near_duplicates(docs_of):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in ROWS]
    root = {i: i for i, _ in ROWS if i is not None}
    for _ in ROWS:
        for i, a in sets:
            for j, b in sets:
                if None not in (i, j) and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    want = sorted(((i, len(s), root.get(i)) for i, s in sets), key=str)
    assert by_id(jaccard_join.near_duplicates(docs_of(ROWS)), "n_shingles", "component_id") == want
    assert jaccard_join.near_duplicates(docs_of([])).count() == 0


def test_chains_of_near_duplicates(docs_of):
    # each links to the next, the ends do not: one component, whose centre misses some
    rows = [(k, " ".join(W[4 * k : 4 * k + 150])) for k in range(12)] + [(50, " ".join(W[:150][::-1]))]
    got = dict((r[0], r[1]) for r in by_id(jaccard_join.near_duplicates(docs_of(rows)), "component_id"))
    assert got == {k: 0 for k in range(12)} | {50: 50}


def test_substring_dedup(docs_of):
    def expected(rows):
        first = {}
        for i, t in rows:
            w = (t or "").split()
            for p in range(len(w) - 49):
                if i is not None:
                    k = tuple(w[p : p + 50])
                    first[k] = min(first.get(k, i), i)
        for i, t in rows:
            w = (t or "").split()
            gone = {q for p in range(len(w) - 49) if i is not None and first[tuple(w[p : p + 50])] < i for q in range(p, p + 50)}
            kept = " ".join(x for q, x in enumerate(w) if q not in gone)
            yield i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()

    got = by_id(substring_dedup.remove_repeats(docs_of(ROWS)), "n_words", "n_removed", "kept_sha256")
    assert got == sorted(expected(ROWS), key=str)
    assert substring_dedup.remove_repeats(docs_of([])).count() == 0


def test_mixing(spark, docs_of):
    rows = [(i, "w " * (1 + i % 7), None, ["a", "b", None, "c"][0 if i < 60 else i % 4]) for i in range(120)] + [(500, None, None, "b"), (501, "", None, "only-empty"), (60, "w w", None, "b")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    out = mixing.mix(docs_of(rows), labels).collect()
    total = sum(r["size"] for r in out)
    assert len(out) == len(rows) and sum({r["source"]: r["target"] for r in out}.values()) == pytest.approx(total)
    for s in {r["source"] for r in out}:
        mine = [r for r in out if r["source"] == s]
        assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 4
        assert mine[0]["target"] <= 3 * mine[0]["source_size"]
        assert max(r["copies"] for r in mine if r["size"]) - min(r["copies"] for r in mine if r["size"]) <= 1 if any(r["size"] for r in mine) else True
    again = mixing.mix(docs_of(rows[::-1]).repartition(7), labels).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix(docs_of([])).count() == 0


def test_language_id(docs_of):
    rows = [(i, "the cat and the dog are here" if i % 2 else "der hund und die katze sind hier", "en" if i % 2 else "de", "s") for i in range(20)]
    model = language_id.train(docs_of([*rows, (99, "nur text", None, "s"), (98, None, "fr", "s")]))
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs_of([(1, "the dog"), (2, "die katze"), (3, None), (4, "12 !!"), (5, ""), (6, "the dog " * 5000)]), model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert got[3][1] == 0 and 0.5 < got[1][1] <= 1
    none = language_id.train(docs_of([]))
    assert {r["lang_pred"] for r in language_id.predict(docs_of([(1, "the")]), none).collect()} == {"und"}


def test_map_only_codecs(docs_of):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    s = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = by_id(token_counts.count_tokens(docs_of(ROWS), public_tokenizers.path("byte_bpe_50k.json")), "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((x or "").encode()), len(t.encode(x or "").ids), len(t.encode(x or "").ids) > 512) for i, x in ROWS]
    assert n == sorted(want, key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    m = by_id(sentencepiece_codec.encode_digests(docs_of(ROWS), public_tokenizers.path("piece_bpe_32k.model")), "n_tokens", "ids_sha256", "decoded_sha256")
    want = [(i, len(s.encode(x or "")), sha(",".join(map(str, s.encode(x or "")))), sha(s.decode(s.encode(x or "")))) for i, x in ROWS]
    assert m == sorted(want, key=str)


def test_top_k(spark):
    rows = [(i, [float((i * 7) % 5) / 3, float(i % 3) - 1, 0.25]) for i in range(130)]
    rows += [(200, None), (250, [1.0, None, 0.0]), (300, [float("nan"), 0.0, 0.0]), (350, [0.0, 0.0, float("inf")]), (3, rows[3][1]), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in topk_search.top_k(table, block=16, query_block=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    import numpy as np

    v = {i: np.floor(256 * np.float32(x).astype(float)) for i, x in rows[:130]}
    for q in (0, 50, 100):
        want = sorted(((-int(v[q] @ v[j]), j) for j in v if j != q))[:5]
        assert sorted(got[q]) == [(k + 1, -s, j) for k, (s, j) in enumerate(want)]
    assert set(got) == {0, 50, 100}
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk_search.top_k(few.where("vec_id > 5")).count() == 0
    with pytest.raises(ValueError):
        topk_search.top_k(spark.createDataFrame([(0, [1e6]), (1, [1.0])], "vec_id long, embedding array<double>"))


def test_warc_archives(spark, tmp_path):
    big = "<p>" + "ü" * 1200
    rows = [(1, None, big), (5, "http://a", big), (3, "http://b c", big), (7, "u", "x"), (8, "u", "x"), (9, None, None), (None, "u", big), (5, "http://z", "other"), (10, "v", "")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, keep long")
    got = zip_warc.read_archives(zip_warc.write_archives(pages, f"file://{tmp_path}/wacz")).collect()
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = h == big and i != 5
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 5 if again else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert zip_warc.read_archives(zip_warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_ppm(docs_of):
    import math
    import zlib

    got = sorted(ppm_scoring.score_texts(docs_of(ROWS), frequent=20).collect(), key=lambda r: str(r["doc_id"]))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, plain = Counter(), ppm_scoring.Adaptive()
    for i, t in ROWS:
        if not held(i):
            c.update(ppm_scoring.tokens(t))
    for w, n in c.items():
        context = b" "
        for s in [10] if w == ppm_scoring.END else [*w, 32]:
            plain.learn(context, s, n)
            context += bytes([s])
    n_all = sum(c.values())
    for r, (i, t) in zip(got, sorted(ROWS, key=lambda x: str(x[0])), strict=True):
        w = ppm_scoring.tokens(t)
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, held(i), len(w), sum(c[x] > 0 for x in w), n_all)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n_all + len(c) + 1)) for x in w))
        assert r["score"] == pytest.approx(plain.code(w, learn=False))
    assert ppm_scoring.score_texts(docs_of([])).count() == 0


def test_ppm_keeps_every_context(docs_of):
    import inspect
    import zlib

    # no size of the trie is a parameter, and rare grams beyond the table that workers hold are joined
    assert not hasattr(ppm_scoring, "MAX_EDGES") and "max_edges" not in inspect.signature(ppm_scoring.score_texts).parameters
    rows = [(i, " ".join(f"w{i * k % 97}é{k}" for k in range(1, 30))) for i in range(40)]
    whole, few = ({r["doc_id"]: r["score"] for r in ppm_scoring.score_texts(docs_of(rows), frequent=9, frequent_grams=n).collect()} for n in (1 << 20, 5))
    plain = ppm_scoring.Adaptive()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            plain.code(ppm_scoring.tokens(t))
    assert whole == pytest.approx({i: plain.code(ppm_scoring.tokens(t), learn=False) for i, t in rows})
    assert few == pytest.approx(whole)


def test_ppm_contexts_reach_over_words(spark, docs_of, tmp_path):
    import zlib

    rows = [*ROWS, (71, "b a d c b a"), (72, "a b c d"), (73, "d c b a"), (74, "a b"), (75, "b a")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = ppm_scoring.op9_ppm(spark, str(tmp_path)).collect()
    plain = ppm_scoring.Adaptive()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            plain.code(ppm_scoring.tokens(t), across=True)
    want = sorted((str(i), plain.code(ppm_scoring.tokens(t), learn=False, across=True)) for i, t in rows)
    assert [i for i, _ in want] == sorted(str(r["doc_id"]) for r in got)
    assert [s for _, s in want] == pytest.approx([s for _, s in sorted((str(r["doc_id"]), r["score"]) for r in got)])
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[72] != pytest.approx(by[73])  # the same words in another order


def test_sentencepiece_spans(docs_of):
    import struct

    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [*ROWS, (81, " two  spaces "), (82, "a\nb \n\nc"), (83, "né ▁ mark"), (84, "日本語 \U0001f9ff x"), (85, "nul\0 é"), (86, "\n"), (87, " ")]
    digests = sentencepiece_codec.encode_digests(docs_of(rows), path).collect()
    spans = sentencepiece_codec.encode_spans(docs_of(rows), path).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["spans_sha256"]) for r in digests)
    flat = lambda r: [x for p in zip(r["begins"], r["ends"], strict=True) for x in p]
    assert got == sorted((str(r["doc_id"]), len(r["ids"]), hashlib.sha256(struct.pack(f"<{2 * len(r['ids'])}i", *flat(r))).hexdigest()) for r in spans)
    by = {r["doc_id"]: r for r in spans}
    for i, t in rows:
        if t and i is not None and i > 80:  # every byte of a text is covered
            assert by[i]["begins"][0] == 0 and by[i]["ends"][-1] == len(t.encode()) and all(b <= e for b, e in zip(by[i]["begins"][1:], by[i]["ends"], strict=False))


def test_language_with_long_texts_alone_is_learnt(docs_of):
    rows = [(i, "the house and the tree", "en", None) for i in range(9)] + [(20 + i, f"das haus und der baum {i} " * n, "de", None) for i, n in enumerate((9, 200))]
    model = language_id.train(docs_of(rows), sample_chars=1000)
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs_of(rows), model).collect()}
    assert got == {r[0]: r[2] for r in rows}
    assert language_id.train(docs_of(rows[:9] + rows[10:]), sample_chars=1000).languages == ["de", "en"]  # longer than the sample


def thue_morse(n):
    """Two different sequences of 2 ** n letters that polynomial hashes modulo powers of two take for equal."""
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_that_defeat_polynomial_hashes(docs_of):
    a, b = thue_morse(10)
    rows = [(1, " ".join([*W[:49], a])), (2, " ".join([*W[:49], b])), (3, a), (4, b)]
    got = by_id(substring_dedup.remove_repeats(docs_of(rows)), "n_removed")
    assert got == [(1, 0), (2, 0), (3, 0), (4, 0)]
    got = dict(by_id(jaccard_join.near_duplicates(docs_of(rows)), "component_id"))
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}  # the first two share 45 of 46 shingles


def components_by_hand(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_groups_larger_than_a_cell_and_more_partners_than_are_tried_first(docs_of, monkeypatch):
    import random

    monkeypatch.setattr(jaccard_join, "CHUNK", 5)
    monkeypatch.setattr(jaccard_join, "NEAREST", 1)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 3)
    rnd = random.Random(9)
    rows = []
    for k in range(40):  # variants of one text at all distances around the threshold
        w = W[:160]
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(160)] = f"x{k}-{rnd.randrange(99)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(W[200 : 200 + n])) for k, n in enumerate((1, 2, 4, 5, 6, 9, 40, 41, 49))]
    got = dict(by_id(jaccard_join.near_duplicates(docs_of(rows)), "component_id"))
    assert got == components_by_hand(rows)


def test_one_id_with_several_texts(docs_of):
    rows = [(1, " ".join(W[:100])), (5, " ".join(W[:100])), (5, " ".join(W[200:300])), (7, " ".join(W[200:300] + ["z"])), (9, "alone here")]
    got = by_id(jaccard_join.near_duplicates(docs_of(rows)), "component_id")
    assert got == [(1, 1), (5, 1), (5, 1), (7, 1), (9, 9)]


def test_numbers_are_not_letters_and_long_texts_train(docs_of):
    long = " ".join(f"wort{chr(97 + i % 26)} haus baum" for i in range(8000))
    assert len(long) > 100_000
    model = language_id.train(docs_of([(1, "the house and the tree " * 3, "en", None), (2, long, "de", None)]))
    assert model.languages == ["de", "en"] and "haus" in model.words
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs_of([(1, "½ ²"), (2, "Ⅷ 12"), (3, "haus"), (4, "_")]), model).collect()}
    assert told[1] == told[2] == told[4] == ("und", 0.0) and told[3][0] == "de"


def test_word_first_backoff_by_hand():
    import math

    texts = [("de", "der hund und der hase"), ("en", "the hound and the hare and the"), ("de", "hund"), ("en", "hare")]
    model = language_id.fit(texts)
    words = {lang: Counter(w for x, t in texts if x == lang for w in t.split()) for lang in ("de", "en")}
    known = {w for w, n in (words["de"] + words["en"]).items() if n > 1}
    grams = {lang: Counter() for lang in words}
    for lang, c in words.items():
        for w, n in c.items():
            p = f"<{w}>"
            for a in range(len(p)):
                for b in range(a + 1, min(a + 4, len(p)) + 1):
                    grams[lang][p[a:b]] += n
    chosen = {g for g, n in (grams["de"] + grams["en"]).items() if n > 2 or len(g) == 1}

    def score(w, lang):
        if w in known:
            return math.log((words[lang][w] + 0.5) / (sum(words[lang].values()) + len(known) + 1))
        of_size = lambda n: sum(v for g, v in grams[lang].items() if len(g) == n) + len(chosen) + 1
        total, rest = 0.0, f"<{w}>"
        while rest:
            part = next((rest[:n] for n in range(min(4, len(rest)), 0, -1) if rest[:n] in chosen), None)
            total += math.log(((grams[lang][part] if part else 0) + 0.5) / of_size(len(part) if part else 1))
            rest = rest[len(part or "x") :]
        return total

    for w in ("hund", "the", "hunde", "thee", "zebra", "hares", "d", "ünd"):
        assert model.word(w) == pytest.approx(tuple(score(w, lang) for lang in ("de", "en")))
    for text in ("der hunde zebra", "the hares thee thee"):
        total = [sum(score(w, lang) for w in text.split()) for lang in ("de", "en")]
        lang, post, n = language_id._Teller(model).one(text)
        assert lang == ("de", "en")[total[1] > total[0]] and n == len(text.split())
        assert post == pytest.approx(1 / sum(math.exp(x - max(total)) for x in total))


def test_language_stage_keeps_rows_as_they_are(spark, docs_of):
    model = language_id.fit([("en", "the cat and the dog and the cat"), ("de", "der hund und die katze und der hund")])
    df = spark.createDataFrame([(1, "the cat", 1), (1, "the cat", 1), (None, "der hund", 2), (2, None, 3), (3, "123", 4)], "doc_id long, text string, TEXT int")
    kept = drop_rows(df, language_id.rejected(df, model, 0.5), "digest")
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if r[1] and r[1] != "123")
    assert language_id.rejected(df.limit(0), model, 0.5).count() == 0


def test_long_texts_are_scanned_in_chunks(docs_of):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [*ROWS, (60, "it's 12  words<|endoftext|>x\n\n" * 40), (61, "y" * 300), (61, "y" * 300), (None, " \n" * 200), (62, "don't é🧿" * 60)]
    got = by_id(token_counts.count_tokens(docs_of(rows), path, chunk=50), "n_bytes", "n_tokens")
    assert got == sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows), key=str)


def test_mix_takes_the_same_rows_with_all_columns(spark, docs_of, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), None, ["a", "b", None, "c"][0 if i < 200 else i % 4]) for i in range(400)] + [(500, None, None, "b"), (501, "", None, "only-empty")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)] + [(None, 1)], "doc_id long, quality int")
    plan = mixing.mix(docs_of(rows), labels).collect()
    want = Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})
    for most in (1_000_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_LABELS", most)
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        got = mixing.mixed(docs_of(rows), labels)
        assert got.columns == docs_of(rows).columns
        assert Counter(r["doc_id"] for r in got.collect()) == want
    by = {}
    for r in plan:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(target - taken) <= 7 / 2 for target, taken in by.values())
    assert mixing.mixed(docs_of(rows).limit(0), labels).count() == 0


def test_texts_go_to_workers_in_small_batches(spark, docs_of):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def most(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    for own in (None, 1 << 20):
        session = spark.newSession()
        docs = session.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 6000).alias("text"))  # 18 MB
        if own:
            session.conf.set(key, str(own))
        sentencepiece_codec.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
        got = [r.n for r in docs.mapInArrow(most, "n long").collect()]
        assert sum(got) > 18_000_000 and max(got) <= (own or BATCH_BYTES) + 64_000
