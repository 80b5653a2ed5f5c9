"""The operators' cores without Spark, against libraries and brute force."""

import random
import struct
import zipfile
from io import BytesIO
from itertools import product

import numpy as np
import public_tokenizers
import pytest

from sparkloom.llm import _words, exact_dedup, jaccard_join, language_id, ppm_scoring, sentencepiece_codec, substring_dedup, token_counts, topk_search, zip_warc
from sparkloom.llm._words import shared, shingle_sets, words

ALPHABET = [*"abst  \n\t'!1é中² 　.rvelmd▁\x00", "  ", "日本", "🙂", "́", "<|endoftext|>", "'re", "'s", "\r\n", "<s>", "<0x0A>"]


def noise(n, most, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def spec():
    return token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_like_the_library(spec):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*noise(1500, 30), "", "x" * 3000, " " * 500, "The quick brown fox's tail. " * 40]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(spec).count(texts) == want
    counter = token_counts.Counter(spec)
    for t, n in zip(texts[:400] + texts[-3:], want[:400] + want[-3:], strict=True):
        assert counter.total([counter.chunk_map(t[i : i + 7]) for i in range(0, len(t), 7)] or [("", 0, None)]) == n


def test_chunk_maps_compose_associatively(spec):
    c = token_counts.Counter(spec)
    text = "Hello there,  world's end\n\n 12 cats' x"
    a, b, d = c.chunk_map(text[:9]), c.chunk_map(text[9:20]), c.chunk_map(text[20:])
    end = lambda m: c._tokens(m[0]) + m[1] + c._tokens(m[2] or "")
    assert end(c.compose(c.compose(a, b), d)) == end(c.compose(a, c.compose(b, d))) == c.count([text])[0]


def test_transducer_states_are_bounded(spec):
    c = token_counts.Counter(spec)
    c.machine.reset()
    assert c.count(["aaaa bbbb", None]) == [c.count(["aaaa bbbb"])[0], 0]


def test_sentencepiece_remembers_equal_spans_once():
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec = sentencepiece_codec.Codec(open(path, "rb").read())
    digester = sentencepiece_codec.Digester(codec, most=400)
    rnd = random.Random(5)
    for _ in range(20):
        texts = [" ".join("".join(rnd.choices("abcdeinorst", k=7)) for _ in range(100))]
        (row,), (span,) = digester.run_spans(texts)
        assert row[1] == ",".join(map(str, codec.encode(texts[0]))) and row[2] == texts[0]
        assert np.frombuffer(span, "<i4").reshape(-1, 2).tolist() == [[a, b] for _, a, b in codec.spans(texts[0])]
        kept = [*digester.rel.values(), *digester.old_rel.values()]
        assert len({*map(id, digester.rel.values())}) == len({*digester.rel.values()}) < len(digester.rel)
        assert len(kept) <= 800 and len({*map(id, kept)}) <= 2 * len({*kept})


def test_sentencepiece_like_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = sentencepiece_codec.Codec(open(path, "rb").read())
    texts = [*noise(1500, 30), "", " a", "a ", "plain words here\nand there", "x" * 2000]
    got = sentencepiece_codec.Digester(codec).run(texts)
    for t, (n, ids, decoded) in zip(texts, got, strict=True):
        want = lib.encode(t)
        assert (n, ids, decoded) == (len(want), ",".join(map(str, want)), lib.decode(want)), t
        assert codec.decode(want) == lib.decode(want)
    assert sentencepiece_codec.Digester(codec).run([None]) == [(0, "", "")]
    small = sentencepiece_codec.Digester(codec, most=3)
    assert [small.run([t])[0] for t in texts[-4:]] == got[-4:]


def test_sentencepiece_spans_cover_the_source():
    codec = sentencepiece_codec.Codec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    for t in ["a é中 b", *noise(50, 20, 3)]:
        data, at = t.encode(), 0
        for i, a, b in codec.spans(t):
            assert at - 4 <= a <= b <= len(data)
            at = b
            piece = codec.pieces[i].replace("▁", " ")
            if codec.kinds[i] != sentencepiece_codec.BYTE and "▁" not in t and not piece.startswith(" "):
                assert data[a:b].decode() == piece
        assert at == len(data)


def test_character_map_takes_the_longest_prefix():
    # a hand-made double array: 'a' -> "x", 'ab' -> "y"
    units = [0] * 512
    unit = lambda label, offset, leaf: (offset << 10) | (leaf << 8) | label
    units[0] = unit(0, 256, 0)
    a = 256 ^ ord("a")
    units[a] = unit(ord("a"), 8, 1)
    units[a ^ 8] = 1 << 31
    ab = a ^ 8 ^ ord("b")
    units[ab] = unit(ord("b"), 16, 1)
    units[ab ^ 16] = 1 << 31 | 2
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"x\0y\0"
    m = sentencepiece_codec.CharacterMap(blob)
    assert m.longest(b"abc", 0) == (b"y", 2)
    assert m.longest(b"acb", 0) == (b"x", 1)
    assert m.longest(b"c", 0) is None


def test_chunks_join_to_the_text():
    rnd = random.Random(2)
    for n in (0, 1, 1023, 2048, 2049, 30000, 300000):
        data = bytes(rnd.choices(range(97, 101), k=n))
        ends = exact_dedup.cut_points(data)
        assert ends == sorted(set(ends)) and (ends[-1] == n if n else ends == [])
        assert all(b - a <= exact_dedup.MOST for a, b in zip([0, *ends], ends, strict=False))
    # an insertion changes the chunks near it alone
    data = bytes(rnd.choices(range(256), k=60000))
    a, b = exact_dedup.recipe_of(data), exact_dedup.recipe_of(b"zz" + data)
    assert len(set(a) & set(b)) > len(a) // 2


def test_sketches_never_miss_a_link():
    rnd = np.random.default_rng(5)
    rule = jaccard_join.Bounds()
    for _ in range(150):
        n = int(rnd.choice([1, 2, 3, 5, 9, 60, 70, 150, 600]))
        a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
        most = rule.reach(len(a))
        cut = int(rnd.integers(0, most + 1))
        keep = rnd.permutation(a)[cut:] if cut < len(a) else a
        new = rnd.integers(0, 1 << 62, max(0, most - cut)).astype(np.uint64)
        b = np.unique(np.concatenate([keep, new]))
        inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * inter < 80 * union:
            continue
        assert len(a) + len(b) - 2 * inter <= rule.difference(len(a), len(b))
        sa, sb = jaccard_join.signatures(a), jaccard_join.signatures(b)
        assert any(x == y and np.isin(p, q).any() for x, p in sa for y, q in sb)
        for band in set(jaccard_join.bands(len(a))) & set(jaccard_join.bands(len(b))):
            far = jaccard_join.distances(np.frombuffer(jaccard_join.parity_bits(a, band), np.uint64)[None, :], jaccard_join.parity_bits(b, band))[0]
            assert far <= len(a) + len(b) - 2 * inter


def test_word_names_follow_content():
    texts = [b"a b  c\td", b"", b" \n ", b"b c d a", b"x" * 100 + b" a"]
    one, two, first = words(texts)
    found = [w for t in texts for w in t.split()]
    assert first.tolist() == [0, 4, 4, 4, 8, 10]
    by = {}
    for w, *n in zip(found, one.tolist(), two.tolist(), strict=True):
        assert by.setdefault(w, n) == n
    assert len({tuple(n) for n in by.values()}) == len(by) == len({n[0] for n in by.values()})
    sets = shingle_sets([b"a b c d e", b"a b c d", b"", b"a b c d e a b c d e", b"a b c d e"])
    assert [len(s[0]) for s in sets] == [len(s[1]) for s in sets] == [1, 1, 0, 5, 1]
    assert sets[0] == sets[4] and sets[0] != sets[1]
    assert shared(sets[0], sets[3]) == 1 and shared(sets[0], sets[1]) == 0


def test_short_words_have_names_of_their_own_that_nobody_remembers():
    _words._names.forget()
    short = [*{bytes(x) for n in range(3) for x in product(b"\0a\x1c\xff", repeat=n + 1)}, *[b"%d" % i for i in range(30_000)], *[b"a" * i for i in range(4, 16)], b"a" * 14 + b"\0"]
    one, two, first = words([b" ".join(short)])
    assert len(_words._names) == 0 and first.tolist() == [0, len(short)]
    assert len({*one.tolist()}) == len({*two.tolist()}) == len(short)
    long = [b"a" * 16, b"a" * 15 + b"\0", b"a" * 17]
    again = words([b"\t" + w + b"\x0b" for w in [*long, *short]])
    assert again[0][3:].tolist() == one.tolist() and again[1][3:].tolist() == two.tolist() and len(_words._names) == 3
    assert len({*again[0].tolist()}) == len(short) + 3


def test_equal_windows_have_equal_representatives():
    rnd = random.Random(3)
    for _ in range(120):
        voc = [f"w{i}" for i in range(rnd.choice([1, 2, 5, 50, 5000]))]
        pick = lambda n: [rnd.choice(voc) for _ in range(n)]  # noqa: B023, E731
        shared = pick(rnd.randint(50, 90))
        texts = [" ".join(pick(rnd.randint(0, 60)) + shared + pick(rnd.randint(0, 60))).encode() for _ in range(2)]
        name, _, first = words(texts)
        seen = {}
        for s, k in zip(*[x.tolist() for x in substring_dedup.representatives(name, first)], strict=True):
            w = tuple(name[s : s + 50].tolist())
            assert seen.setdefault(w, k) == k
        assert seen


def test_cover_tree_invariants_and_search():
    rng = np.random.default_rng(0)
    x = np.floor(256 * np.concatenate([rng.normal(size=(300, 8)), np.zeros((5, 8)), rng.normal(5, 0.1, size=(200, 8))]))
    t = topk_search.CoverTree(x, leaf=8)
    assert sorted(t.order) == list(range(len(x)))
    for i in range(len(t.first)):
        rows = t.order[t.first[i] : t.last[i]]
        assert t.centre[i] in rows
        assert np.sqrt(((x[rows] - x[t.centre[i]]) ** 2).sum(1)).max() <= t.radius[i] + 1e-6
        if t.children[i]:
            assert sum(t.last[c] - t.first[c] for c in t.children[i]) == len(rows)
            assert t.centre[t.children[i][0]] == t.centre[i]
    q = topk_search.CoverTree(x[:60], leaf=4)
    ids, own = np.arange(len(x)), np.arange(60)
    best, best_id = np.full((60, 5), -np.inf), np.full((60, 5), 1 << 60)
    taken = topk_search.dual_search(q, t, ids, own, best, best_id)
    s = x[:60] @ x.T
    s[np.arange(60), np.arange(60)] = -np.inf
    for i in range(60):
        want = sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:5]
        assert best_id[i].tolist() == want
    assert taken < 60 * len(x)


def test_zip_directory_with_and_without_zip64(tmp_path):
    for wide in (False, True):
        buffer = BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
            with z.open(zipfile.ZipInfo("a.bin"), "w", force_zip64=wide) as f:
                f.write(b"hello")
            z.writestr("dir/b.txt", "second")
            z.comment = b"PK\x05\x06 no end"
        data = buffer.getvalue()
        if wide:  # a ZIP64 end record and locator in front of an end record that tells nothing
            end = data.rfind(b"PK\x05\x06", 0, data.rfind(b"PK\x05\x06"))
            _, _, n, _, size, offset = struct.unpack_from("<HHHHII", data, end + 4)
            wide_end = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, offset)
            locator = b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
            data = data[:end] + wide_end + locator + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
        read_at = lambda at, k: data[at : at + k]  # noqa: B023, E731
        members = zip_warc.central_directory(read_at, len(data))
        assert [(m.name, m.method, m.size) for m in members] == [("a.bin", 0, 5), ("dir/b.txt", 0, 6)]
        at = zip_warc.data_offset(read_at, members[1])
        assert data[at : at + 6] == b"second"
    with pytest.raises(ValueError):
        zip_warc.central_directory(lambda at, k: b"x" * k, 100)


def test_warc_record_round_trip():
    import hashlib

    payload = "<p>ü\r\n\r\n</p>".encode()
    digest = hashlib.sha1(payload).hexdigest()
    assert zip_warc._row(*zip_warc.parse_record(zip_warc.warc_record(7, "http://a b/ü", payload, digest))) == (7, payload, len(payload), digest, "response", None)
    assert zip_warc._row(*zip_warc.parse_record(zip_warc.warc_record(3, None, payload, digest, 7))) == (3, None, len(payload), digest, "revisit", 7)
    assert zip_warc._row(*zip_warc.parse_record(zip_warc.warc_record(None, "", b"", hashlib.sha1(b"").hexdigest())))[:3] == (None, b"", 0)


def test_trained_model_is_plain_ppm():
    rnd = random.Random(4)
    words_ = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 9))).encode() for _ in range(60)] + [ppm_scoring.END]
    n = np.array([rnd.randint(1, 9) for _ in words_])
    plain = ppm_scoring.Adaptive()
    for w, k in zip(words_, n.tolist(), strict=True):
        context = b" "
        for s in [10] if w == ppm_scoring.END else [*w, 32]:
            plain.learn(context, s, k)
            context += bytes([s])
    model = ppm_scoring.Model(*ppm_scoring.edge_counts(words_, n))
    new = [*words_, b"zz", b"abz", b"cab", b"\xff\x00", b"a" * 50]
    assert np.allclose(model.score(new), [plain.code([w], learn=False) for w in new])
    assert np.allclose(ppm_scoring.Model(np.zeros(0, np.int64), np.zeros(0, np.int64)).score([b"ab"]), -3 * np.log10(256))
    assert sum(10 ** plain.log10(b" ab", s) for s in range(256)) == pytest.approx(1)
    assert ppm_scoring.Adaptive().code([b"aaaaaaaa"] * 20) > 20 * ppm_scoring.Adaptive().code([b"aaaaaaaa"])


def test_language_model_backs_off():
    m = language_id.fit([("en", "the cat and the dog the the cat dog"), ("de", "der hund und die katze der hund die katze")])
    assert m.languages == ["de", "en"]
    best = lambda w: m.languages[int(np.argmax(m.word(w)))]
    assert (best("the"), best("katze"), best("hundkatze"), best("catdog")) == ("en", "de", "de", "en")
    assert language_id.fit([]).languages == []
