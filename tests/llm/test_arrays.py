"""Parts that need no session: codes, pieces, trees, automata, keys."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from shelfwise.llm import bpe, elias_fano, jaccard, langid, merkle, packing, quality, secrets, token_files, warc
from shelfwise.llm.nn_descent import connecting
from shelfwise.llm.pieces import PieceEncoder, WordEncoder, library_encoder, tokenizer_path
from shelfwise.llm.shingles import set_digest, shingle_sets
from shelfwise.llm.signature_tree import SignatureTree

CHARACTERS = [*"aabcdeéèßñ AZ'.,!?-|*#$% \n\n\t  0123٣²½\x1c\x85́Σςαж漢字　 ", "<|endoftext|>", "<|startoftext|>", "'s", "'ll"]


def odd_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(CHARACTERS, k=rng.randint(0, 16))) for _ in range(n)]


def library_ids(name: str, texts: list[str]) -> list[bytes]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [np.asarray(e.ids, dtype="<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_pieces_give_the_ids_of_whole_texts(name, kind):
    texts = odd_texts(4000)
    encode = library_encoder(tokenizer_path(name), kind)
    assert list(encode.many(texts)) == library_ids(name, texts)
    assert len(encode.memo) > 0


# Capitals with marks that have no composed capital, letters that change their length in lower case, signs by other names.
MARKED = [*"aehkHKTS İıŉſŽœ×÷;K`ǅ가한😀12'’-_<>|/\x00\x7f\x1c\t\u0331\u0327\u0301\u0308\u0338\u200b\ufeff\u2028", "'LL", "<|endof", "text|>"]


def test_words_by_arrays_give_the_ids_of_whole_texts():
    rng = random.Random(5)
    texts = ["", "İ, x", "İ's", "H\u0331 h\u0331", "", *("".join(rng.choices(MARKED, k=rng.randint(0, 20))) for _ in range(6000)), "x" * 70_000]
    encode = library_encoder(tokenizer_path("word_bpe_49k.json"), "word")
    want = library_ids("word_bpe_49k.json", texts)
    assert list(encode.many(texts)) == want
    assert [encode(t) for t in texts[:300]] == want[:300]
    assert list(encode.many([])) == []


def test_the_library_sees_each_word_once():
    """Whatever its case, its surroundings and the number of texts; two generations keep what is in use, and no long piece is kept."""
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return [p.decode().encode("utf-32-le") for p in pieces]

    encoder = WordEncoder(encode, lambda t: t.encode("utf-32-le"), ["<|x|>"], entries=8)
    long = "y" * 60
    texts = ["The the THE", "été,the( été) 12-21", "don't DON", "<|x|> a", long]
    want = ["thethethe", "été,the(été)12-21", "don'tdon", "<|x|> a", long]
    assert list(encoder.many(texts)) == [w.encode("utf-32-le") for w in want]
    assert sorted(p.decode() for p in asked) == sorted(["the", "été", ",", "(", ")", "1", "2", "-", "don", "'t", long])
    assert long.encode() not in encoder.memo
    for i in range(40):
        assert encoder(f"the word{'abcdefghijklmnopqrstuvwxyz'[i % 26]}") == f"theword{'abcdefghijklmnopqrstuvwxyz'[i % 26]}".encode("utf-32-le")
        assert len(encoder.memo) + len(encoder.older) <= 8 + 10
    assert asked.count(b"the") == 1 and asked.count(b"worda") == 2


def test_segment_tree_equals_the_library():
    texts = [*odd_texts(4000, 2), "a" * 3000 + "thequickbrown" * 300, "", " "]
    b = bpe.byte_bpe(tokenizer_path("byte_bpe_50k.json"))
    found = list(b.encode_many(texts))
    assert found == library_ids("byte_bpe_50k.json", texts)
    assert [b.decode(ids).decode() for ids in found] == texts


def test_rows_of_trees_equal_one_tree():
    b = bpe.byte_bpe(tokenizer_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    rows = np.full((500, 32), -1)
    words = []
    for row in rows:
        data = rng.choice([116, 104, 101, 32, 97, 97, 110], size=rng.integers(1, 33))
        ids = [b.byte_ids[x] for x in data]
        row[: len(ids)] = ids
        words.append(bpe.merge_pairs(ids, b.pairs))
    assert [[i for i in row if i >= 0] for row in bpe.merge_rows(rows, b.table).tolist()] == words


def test_decoding_ids_that_are_no_text():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    ids = [b for b in range(0, 256, 3)]
    want = Tokenizer.from_file(path).decode(ids, skip_special_tokens=False)
    assert bpe.byte_bpe(path).decode(np.asarray(ids, "<u4").tobytes()).decode() == want


@pytest.mark.parametrize("seed", range(20))
def test_elias_fano_selects_what_was_coded(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 3000))
    high = 2 ** int(rng.integers(1, 62))
    v = np.sort(rng.integers(-high, high, n))
    e = elias_fano.EliasFano(elias_fano.encode(v))
    ask = rng.integers(0, n, 50) if n else np.zeros(0, int)
    assert (e.select(ask) == v[ask]).all()
    assert len(e) == n


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(0, 2000, 50_000))
    assert len(elias_fano.encode(ends)) * 8 / len(ends) < 2 + np.log2(ends[-1] / len(ends)) + 1


def test_token_file_round_trip():
    docs = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 1, 500)]
    for width in (2, 4):
        f = token_files.TokenFile(b"".join(token_files.pack_file([None, -5, 7, 7], docs, width)))
        assert f.doc_ids() == [None, -5, 7, 7]
        assert [f.document(i).astype("<u4").tobytes() for i in range(4)] == docs
        assert f.offsets(np.arange(5)).tolist() == [0, 3, 3, 4, 504]
    with pytest.raises(ValueError):
        token_files.TokenFile(b"something else entirely")


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 4, 40)])
def test_packing_keeps_limits_and_every_id(limits):
    rng = np.random.default_rng(4)
    p = packing.Packer(limits)
    examples = [packing.Example(i, rng.bytes(4 * int(n)), int(c)) for i, (n, c) in enumerate(zip(rng.geometric(0.004, 3000), rng.integers(0, 30, 3000)))]
    for e in examples:
        e.context = min(e.context, e.tokens - 1)
        p.add(e)
        if p.full:
            p.close_window()
    p.close_window()
    pieces = {}
    for s in p.sequences:
        assert sum(n for _, _, n in s) <= limits.tokens
        assert len(s) <= limits.segments
        assert sum(e.loss(a, n) for e, a, n in s) <= limits.loss
        for e, a, n in s:
            assert n > 0
            pieces.setdefault(e.doc_id, []).append((a, n))
    for e in examples:
        at = 0
        for a, n in sorted(pieces[e.doc_id]):
            assert a == at
            at += n
        assert at == e.tokens
    if limits == packing.Limits():
        sizes = [sum(n for _, _, n in s) for s in p.sequences]
        assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes) < 0.01 * sum(sizes)


def test_warc_scan_knows_records_from_look_alikes(tmp_path):
    import hashlib

    inner = warc.record(9, "u", b"z", hashlib.sha1(b"z").hexdigest(), None)
    payloads = [inner * 2, b"", b"WARC/1.1\r\nContent-Length: 5\r\n\r\n", b"WARC/1.1\r\n", b"x" * 5000]
    data = b"".join(warc.record(i, f"http://h/{i}", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads))
    (tmp_path / "a.warc").write_bytes(data)
    with warc._open(str(tmp_path), "a.warc") as f:
        found = warc.scan_range(f, 0, len(data), len(data))
        assert len(found) > len(payloads)
        records = list(warc.read_range(f, 0, len(data), len(data)))
    assert [r["block"].split(b"\r\n\r\n", 1)[1] for r in records] == payloads


def test_broken_warc_raises(tmp_path):
    data = warc.record(1, None, b"abc", "00" * 20, None)
    (tmp_path / "a.warc").write_bytes(data[:-3] + b"???")
    with warc._open(str(tmp_path), "a.warc") as f, pytest.raises(ValueError):
        list(warc.read_range(f, 0, len(data), len(data)))


def reference_shingles(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())


def test_shingle_sets_name_what_they_should():
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab A\t\n\x85é\x1c", k=rng.randint(0, 40))) for _ in range(5000)] + [None, "", " \n", "\x00 \x00\x00 a b"]
    to, back = {}, {}
    for text, s in zip(texts, shingle_sets(texts), strict=True):
        want = frozenset(reference_shingles(text))
        assert len(s) == len(want)
        assert to.setdefault(want, set_digest(s)) == set_digest(s)
        assert back.setdefault(set_digest(s), want) == want


def random_set(rng, n: int) -> np.ndarray:
    return np.unique(rng.integers(0, 2**63, n, dtype="uint64") * np.uint64(2) + np.uint64(1))


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(6)
    linked = 0
    for i in range(2500):
        a = random_set(rng, int(rng.integers(5, 40) if i % 2 else rng.integers(20, 700)))
        most = int(len(a) * 0.2) + 2
        b = np.unique(np.concatenate([np.sort(rng.permutation(a)[: max(1, len(a) - int(rng.integers(0, most)))]), random_set(rng, int(rng.integers(0, most)))]))
        common = len(np.intersect1d(a, b))
        union = len(a) + len(b) - common
        if 100 * common >= percent * union and common < union:
            linked += 1
            assert len(np.intersect1d(jaccard.keys_of(a, percent), jaccard.keys_of(b, percent)))
    assert linked > 300


@pytest.mark.parametrize("seed", range(8))
def test_tree_connects_as_brute_force_does(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(int(rng.integers(1, 40))):
        base = random_set(rng, int(rng.integers(1, 250)))
        for _ in range(int(rng.integers(1, 14))):
            kept = rng.permutation(base)[: max(1, len(base) - int(rng.integers(0, len(base) * 0.1 + 1)))]
            sets.append(np.unique(np.concatenate([kept, random_set(rng, int(rng.integers(0, len(base) * 0.08 + 1)))])))
    near = np.zeros((len(sets), len(sets)), bool)
    for i, a in enumerate(sets):
        for j in range(i):
            c = len(np.intersect1d(a, sets[j]))
            near[i, j] = near[j, i] = 100 * c >= 85 * (len(a) + len(sets[j]) - c)
    labels = lambda links: label(len(sets), links)
    assert labels(SignatureTree(sets, 85).connect()) == labels(connecting(near))


def label(n: int, links) -> list[int]:
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_automaton_accepts_substrings_only():
    rng = random.Random(7)
    text = [rng.randint(0, 3) for _ in range(200)]
    step = langid.suffix_automaton(text)
    inside = {tuple(text[i:j]) for i in range(200) for j in range(i + 1, min(200, i + 6) + 1)}
    for _ in range(3000):
        word = tuple(rng.randint(0, 3) for _ in range(rng.randint(1, 6)))
        state = 0
        for c in word:
            state = step[state].get(c) if state is not None else None
        assert (state is not None) == (word in inside)


def greedy_phrases(sample: str, text: str) -> int:
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        if end == len(text) and text[at:end] in sample:
            break
        n += 1
        at = end
    return n + 1


def test_phrases_equal_greedy_parsing():
    rng = random.Random(8)
    sample = "".join(rng.choices("abcd", k=300))
    model = langid.LanguageModel([("x", sample)])
    texts = ["".join(rng.choices("abcde", k=rng.randint(1, 250))) for _ in range(100)]
    found, sizes = model.phrases(texts)
    assert found[0].tolist() == [greedy_phrases(sample, t) for t in texts]
    assert sizes.tolist() == [len(t) for t in texts]


def test_language_of_odd_texts():
    model = langid.LanguageModel([("en", "the cat sat on the mat and the dog ran"), ("fr", "le chat est sur le tapis et le chien court")])
    langs, scores, _ = model.predict([None, "", "123 !?", "the dog sat", "le chien est", "the " * 5000])
    assert langs == ["und", "und", "und", "en", "fr", "en"]
    assert scores[:3] == [0, 0, 0]
    assert all(0 <= s <= 1 for s in scores)
    assert langid.LanguageModel([]).predict(["text"])[0] == ["und"]


def test_quality_prefers_good_text():
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 300)}" for _ in range(300)]
    good = [" ".join(rng.choices(words, k=60)) for _ in range(100)]
    bad = ["%%% ".join(rng.choices("xyz#", k=60)) for _ in range(100)]
    model = quality.QualityModel(quality.dictionary(good), quality.dictionary(bad))
    assert model.feature(good[0]) > model.feature(bad[0])
    assert model.saved(None) == model.saved("") == (0, 0)
    x = np.array([model.feature(t) for t in good + bad])
    model.slope, model.shift, model.middle, model.scale = quality.logistic(x, np.array([1.0] * 100 + [0.0] * 100), np.ones(200))
    assert model.score(good[1]) > 0.9 > 0.1 > model.score(bad[1])


BASE = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def test_pattern_spans_equal_the_plain_patterns():
    rng = random.Random(10)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", '"', "'", " ", ":", "=", "abc", "a1B2c3", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ſecret", "\n", "é"]
    for _ in range(5000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        want = [(m.start(), 0, m.end()) for m in BASE.finditer(t) if len(m[1]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secrets.pattern_spans(t) == sorted(want)


def test_novelty_reports_what_does_not_compress():
    text = "the signing credential is wJalrXUtnFEMI7K7MDENGbPxRfiCYzz99 and that is all"
    base, novel = secrets.find_spans(text)
    assert base == [] and [text[a:b] for a, _, b in novel] == ["wJalrXUtnFEMI7K7MDENGbPxRfiCYzz99"]
    assert secrets.find_spans("my credential application1json2request3 repeats " + "credential x9x9x9x9x9x9x9x9x9x9x9x9x9x9x9x9x9x9x9x9")[1] == []
    assert secrets.find_spans("no context wJalrXUtnFEMI7K7MDENGbPxRfiCYzz99")[1] == []
    assert secrets.masked("a token=abcdef1 b") == "a <assign> b"
    assert secrets.masked("") == ""


def test_merkle_fingerprints():
    one = "First line here.\nSecond line is a bit longer than the first.\n\nNew section.\n" + "And a sentence of some length follows here. " * 20
    tree = merkle.MerkleTree.of(one)
    assert "".join(merkle.paragraphs(one)) == one
    assert merkle.MerkleTree.parse(tree.fingerprint()) == tree
    assert tree.likeness(merkle.MerkleTree.of(one)) == 1
    other = merkle.MerkleTree.of(one.replace("Second", "Zecond"))
    assert 0.8 < tree.likeness(other) < 1
    assert [one[a:b] for a, b in tree.edits(other)] == ["Second line is a bit longer than the first.\n"]
    assert tree.edits(tree) == []
    empty = merkle.MerkleTree.of("")
    assert empty.likeness(empty) == 1 and empty.likeness(tree) == 0 == tree.likeness(empty)
    assert merkle.MerkleTree.parse(empty.fingerprint()) == empty
    long = merkle.MerkleTree.of("x" * 100_000)
    assert merkle.MerkleTree.parse(long.fingerprint()).size == 100_000


def test_memo_of_two_generations():
    """Whatever is forgotten, ids stay; pieces in use move to the younger generation."""
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return [p.encode("utf-32-le") for p in pieces]

    encoder = PieceEncoder("byte", encode, [], entries=8)
    for i in range(40):
        text = f"the word{'abcdefghijklmnopqrstuvwxyz'[i % 26]} of"
        assert encoder(text) == text.encode("utf-32-le")
        assert len(encoder.memo) + len(encoder.older) <= 8 + 3 * 2
    assert asked.count("the") == 1 and asked.count(" of") == 1 and asked.count(" worda") == 2


def test_small_memo_takes_few_pieces_at_once():
    """New pieces of one call stay in proportion to the memo, so a small memo bounds what a worker holds."""
    asked = []

    def encode(pieces):
        asked.append(sum(map(len, pieces)))
        return [p.encode("utf-32-le") for p in pieces]

    encoder = PieceEncoder("byte", encode, [], entries=50)
    texts = [f"{i:05d} {i * i:05d}" for i in range(200)]
    assert list(encoder.many(texts)) == [t.encode("utf-32-le") for t in texts]
    assert max(asked) <= 50 + len(texts[-1])


def test_language_sample_is_an_even_share():
    """Every text gives its share, whatever sorts first, and the bound holds; a language in two scripts learns both."""
    assert langid.even_share([5, 9, 30], 100) == 30
    assert langid.even_share([5, 9, 30], 30) == 16 and langid.even_share([10, 10, 10], 12) == 4
    assert langid.even_share([], 5) == 0
    rng = random.Random(4)
    latin = ["".join(rng.choices("abcdefgh ", k=300)) for _ in range(200)]
    greek = ["".join(rng.choices("αβγδεζηθ ", k=300)) for _ in range(200)]
    letters = langid.Alphabet(latin + greek)
    for most in (2000, 40_000):
        taken = langid.sample_symbols(latin + greek, letters, most)
        assert 0.9 * most <= len(taken) <= most
        firsts = set(letters.symbols("abcdefgh").tolist())
        share = sum(s in firsts for s in taken) / len(taken)
        assert 0.2 < share < 0.7
    assert langid.sample_symbols(latin, letters, 5000) == langid.sample_symbols(latin[::-1], letters, 5000)


def test_predictions_equal_counts_of_phrases():
    """Prediction against a plain count of longest matches in the sample, stretch by stretch."""
    rng = random.Random(5)
    words = {"a": "north wind and the sun were disputing".split(), "b": "der nordwind und die sonne stritten".split()}
    samples = [(k, " ".join(rng.choices(w, k=60))) for k, w in words.items() for _ in range(5)]
    model = langid.LanguageModel(samples)
    texts = [" ".join(rng.choices(words[rng.choice("ab")], k=rng.randrange(1, 90))) for _ in range(40)] + ["x", "7 y!", "sun " * 200]
    langs, _, _ = model.predict(texts)
    most = min(langid.SAMPLE_SYMBOLS, langid.ALL_SYMBOLS // 2)
    for text, got in zip(texts, langs, strict=True):
        symbols = bytes(model.letters.symbols(text).tolist())
        bits = []
        for k, per_phrase in zip(model.langs, model.bits, strict=True):
            learned = bytes(langid.sample_symbols([t for own, t in samples if own == k], model.letters, most))
            phrases = 0
            for begin in range(0, len(symbols), langid.STRETCH):
                part = symbols[begin : begin + langid.STRETCH]
                while part:
                    n = 1
                    while n < len(part) and part[: n + 1] in learned:
                        n += 1
                    phrases, part = phrases + 1, part[n:]
            bits.append(phrases * per_phrase)
        assert got == model.langs[int(np.argmin(bits))]
