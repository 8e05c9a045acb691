"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelight.llm import html_blocks, licenses, line_quality, line_windows, mixing, ngram_join, order_minhash, pieces, substring, toxicity
from cuelight.llm.crf import Crf, train
from cuelight.llm.fm_index import FmIndex, WaveletMatrix
from cuelight.llm.graph import components
from cuelight.llm.mixing import copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, _id long, bucket string, kept string, n long"


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    full = [(i, t, "en", s, len(t or ""), 1, "k", 2, "b", "x", 3) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    """Random prose of few words, exact and near copies, shared passages, periodic and very long texts, blanks and nulls."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    out, passage = [], prose(45)
    base = prose(160)
    for i in range(60):
        words = prose(rng.randint(1, 120))
        if i % 5 == 0:
            words += passage[i % 3 :]
        out.append("\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)))
    for i in range(40):  # near copies with one to four edits
        words = list(base)
        for _ in range(1 + i % 4):
            words[rng.randrange(len(words))] = f"e{i}"
        out.append(" ".join(words))
    out += [out[3], out[3], out[7], "Und " * 300, "a b a b " * 40, " ".join(prose(20000)), "", "   \t\n", None, None, "one", "One", "two words", "x" * 50000]
    return [(i, t, None if i % 11 == 0 else f"s{i % 3 if i % 4 else 0}") for i, t in enumerate(out)]


def words_of(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def brute_components(rows, n, percent):
    sets = {}
    for i, t, _ in rows:
        w = words_of(t, True)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join_is_exact(spark, rows, n, percent):
    want = brute_components(rows, n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(table(spark, rows), n, percent, 4).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 10


def test_ngram_join_keeps_one_row_of_each_group(spark, rows):
    want = brute_components(rows, 5, 80)
    docs = table(spark, [*rows, rows[3], (None, rows[5][1], "s"), (None, "", "s")])
    kept = ngram_join.without_near_copies(docs)
    assert kept.columns == docs.columns
    got = collections.Counter(r.doc_id for r in kept.collect())
    blank = {i for i, t, _ in rows if not words_of(t)}
    assert got == collections.Counter({c for i, (_, c) in want.items() if i not in blank} | blank | {None})


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}


def test_substring_dedup_is_exact(spark, rows):
    seen, want = set(), {}
    for i, t, _ in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        want[i] = (" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone))
    got = {r.doc_id: (r.kept, r.n_words, r.n_removed) for r in substring.dedup_substrings(table(spark, rows)).collect()}
    assert got == want
    crowded, substring.CROWDED, size, substring.SHARD_WORDS = substring.CROWDED, 0, substring.SHARD_WORDS, 200
    try:  # crowded keys are dealt window by window; shards are cut small
        for width in (substring.CROWDED, 1 << 30):
            substring.CROWDED = width
            assert {r.doc_id: r.kept for r in substring.dedup_substrings(table(spark, rows)).collect()} == {i: v[0] for i, v in want.items()}
    finally:
        substring.CROWDED, substring.SHARD_WORDS = crowded, size


def without_repeats(rows, width=20):
    """Brute force over rows in their order: the words that are left of each (doc_id, text), repeated rows being one document."""
    seen, want = set(), {}
    for i, t in dict.fromkeys((i, t) for i, t, _ in rows):
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if tuple(w[k : k + width]) in seen:
                gone[k : k + width] = [True] * width
            seen.add(tuple(w[k : k + width]))
        want[i, t] = (" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone))
    return want


def cut_rows(docs):
    """The operator's rows, counted."""
    return collections.Counter((r.doc_id, r.kept, r.n_words, r.n_removed) for r in substring.dedup_substrings(docs).collect())


def test_substring_dedup_decides_repeated_rows_alike(spark, rows):
    again = [*rows, rows[3], rows[3], rows[40], rows[62], rows[103], rows[105], rows[106], rows[108]]
    want = without_repeats(again)
    crowded = substring.CROWDED
    try:
        for substring.CROWDED in (crowded, 0):
            assert cut_rows(table(spark, again)) == collections.Counter((i, *want[i, t]) for i, t, _ in again)
    finally:
        substring.CROWDED = crowded


def test_substring_dedup_parts_rows_of_one_or_no_doc_id(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    low = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=2).digest(), "big") & 0x7FFF
    shared, tail = prose(40), prose(25)
    rows, met = [(7, shared), (None, prose(200) + " " + shared), (None, shared + " " + prose(30)), ((1 << 63) - 1, shared)], {}
    while len(rows) < 12:  # pairs of texts of one 15-bit hash, one with a repeat, one clean and short
        long, short = f"{prose(60)} {shared}", prose(22)
        met[low(long)] = long
        if low(short) in met:
            rows += [(None if len(rows) % 4 else 8, t) for t in (met.pop(low(short)), short)]
    rows += [(None, f"{prose(3)} {tail}") for _ in range(6)] + [(5, f"{prose(5)} {tail}"), (5, f"{prose(6)} {tail}"), (5, None), (None, None), (None, "")]
    got = collections.Counter((r.doc_id, r.kept) for r in substring.dedup_substrings(table(spark, [(i, t, "s") for i, t in rows])).collect())
    gone = lambda t, passage: " ".join((t or "").replace(passage, " ").split())
    want = collections.Counter((i, t if (i, t) == (7, shared) else gone(gone(t, shared), tail)) for i, t in rows)
    more = got - want
    assert sum(more.values()) == 1 and more == collections.Counter(k for k in got if k[0] == 5 and k[1].endswith(tail))  # one of doc_id 5 has it first


def test_substring_dedup_gathers_no_hot_window(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    prose = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passage = prose(26)
    rows = [(i, " ".join(prose(30) + passage + prose(i % 40)), "s") for i in range(80)]
    rare = prose(30)  # this one is indexed
    rows += [(i, " ".join(prose(9) + rare + prose(9)), "s") for i in range(80, 83)]
    search, folder = substring._search, str(tmp_path)

    def watched(width):
        inner = search(width)

        def rows(batches):
            seen = collections.Counter()

            def tee():
                for batch in batches:
                    seen.update(batch.column("key").to_pylist())
                    yield batch

            yield from inner(tee())
            open(f"{folder}/{id(seen)}-{max(seen.values(), default=0)}", "w").close()

        return rows

    monkeypatch.setattr(substring, "_search", watched)
    monkeypatch.setattr(substring, "CROWDED", 8)
    want = without_repeats(rows)
    assert cut_rows(table(spark, rows)) == collections.Counter((i, *want[i, t]) for i, t, _ in rows)
    assert sum(v[2] for v in want.values()) == 79 * len(passage) + 2 * len(rare)
    most = [int(f.name.rsplit("-", 1)[1]) for f in tmp_path.iterdir()]
    assert most and max(most) <= substring.CROWDED  # rows of one key in a task that builds indexes


def test_wavelet_ranks_and_matching_statistics():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 37, 1000)
    tree = WaveletMatrix(values, 6)
    c, lo, hi = rng.integers(0, 37, 50), rng.integers(0, 500, 50), rng.integers(500, 1001, 50)
    a, b = tree.rank(c, lo, hi)
    assert a.tolist() == [int((values[:x] == s).sum()) for s, x in zip(c, lo)]
    assert b.tolist() == [int((values[:x] == s).sum()) for s, x in zip(c, hi)]
    symbols = np.append(rng.integers(1, 4, 600), 0)
    other = rng.integers(1, 5, 300)
    index = FmIndex(symbols, 7)
    found = index.matches(other, np.array([0, 100]), np.array([100, 300])) >= 0
    inside = {tuple(symbols[k : k + 7]) for k in range(len(symbols) - 7)}
    for begin, end in ((0, 100), (100, 300)):
        assert found[begin:end].tolist() == [k + 7 <= end and tuple(other[k : k + 7]) in inside for k in range(begin, end)]


def test_line_windows(spark):
    a, b, c, d = "first line", "second line", "third line", "fourth"
    rows = [(1, "\n".join([a, b, c, d]), "s"), (2, "\n".join(["new", a, b, c, "end"]), "s"), (3, "\n".join([b, c, d]), "s"), (4, "\n\n\n\n", "s"), (5, "\n\n\n", "s"),
            (6, None, "s"), (7, "", "s"), (8, a, "s"), (9, "\n".join(["r", "r", "r", "r"]), "s"), (None, "\n".join([a, b, c]), "s"), (1, "\n".join([a, b, c, d]), "s")]
    got = [(r.id, r.kept, r.n_lines, r.n_removed) for r in line_windows.dedup_lines(table(spark, rows)).select(F.col("_doc.doc_id").alias("id"), "_lines.*").collect()]
    want = [(1, rows[0][1], 4, 0), (1, rows[0][1], 4, 0), (2, "new\nend", 5, 3), (3, "", 3, 3), (4, "\n\n\n\n", 5, 0), (5, "\n\n\n", 4, 0), (6, None, 0, 0), (7, "", 1, 0),
            (8, a, 1, 0), (9, "r", 4, 3), (None, "", 3, 3)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = line_windows.with_lines_removed(table(spark, rows))
    assert sorted((r.doc_id or 0, r.n_chars) for r in kept.collect() if r.doc_id == 2) == [(2, 7)]
    assert None not in [r.doc_id for r in kept.collect()]


def test_mixing_meets_its_targets(spark, rows):
    docs = table(spark, rows)
    got = copies(docs, entropy=0.9999, repeats=3.0).select("_doc.doc_id", "_doc.source", "n_tokens", "n_copies").collect()
    assert len(got) == len(rows) and all(r.n_copies >= 1 for r in got)
    size, taken = collections.Counter(), collections.Counter()
    for r in got:
        size[r.source] += r.n_tokens
        taken[r.source] += r.n_tokens * r.n_copies
    repeats = {s: taken[s] / size[s] for s in size}
    assert max(repeats.values()) <= 3.0 + 1e-6
    assert min(size, key=size.get) == max(repeats, key=repeats.get)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs).count() == sum(r.n_copies for r in copies(docs).collect())


def test_mixing_does_not_depend_on_the_order_of_rows(spark):
    rows = [(None if i % 3 else i // 6, "big" if i % 5 else None, "w " * (1 + i * 7 % 11) + str(i % 40)) for i in range(240)] + [(1000, "small", "a b c")]
    schema = "doc_id long, source string, text string"

    def counted(order):
        got = copies(spark.createDataFrame(order, schema).repartition(3)).groupBy("_doc", "n_copies").count().collect()
        return sorted((str(r["_doc"]), r["n_copies"], r["count"]) for r in got)

    first = counted(rows)
    assert len({n for _, n, _ in first}) > 1
    assert first == counted(rows[::-1]) == counted(rows[1::2] + rows[::2])


def test_fingerprints_follow_edits(spark, rows):
    docs = table(spark, [*rows, (2000, rows[0][1], "s")])
    by = sorted([*rows, (2000, rows[0][1], "s")], key=lambda r: -r[0])
    got = {r.doc_id: r for r in order_minhash.edit_probe(docs, 7).collect()}
    for k, (i, t, _) in enumerate(by):
        t, follow = t or "", by[(k + 1) % len(by)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[2000].fingerprint == got[0].fingerprint
    long = [got[i] for i, t, _ in rows if len(words_of(t)) > 60 and len(set(words_of(t))) > 20]
    assert abs(np.mean([r.near_edited for r in long]) - 0.5) < 0.15
    single = order_minhash.edit_probe(table(spark, [(None, "just one", "s")]), 3).collect()
    assert [(r.doc_id, r.n_chars) for r in single] == [(None, 8)]


def test_pieces_match_the_library_and_spans_cover_the_text(spark, rows):
    import sentencepiece

    model = pieces.public_model()
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [t for _, t, _ in rows][-20:] + ["  two  spaces\tand\nlines ", "Ωmega ½ ﬁ 🤗 é", "▁ under"]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for r in pieces.encode(docs, model).collect():
        t = texts[r._doc.doc_id] or ""
        assert r._pieces.ids == library.encode(t) and r._pieces.decoded == library.decode(library.encode(t))
        spans = list(zip(r._pieces.starts, r._pieces.ends))
        assert b"".join(t.encode()[a:b] for a, b in spans) == t.encode()
    got = {r.doc_id: r for r in pieces.digests(docs, model).select("_doc.doc_id", "_digest.*").collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[i].n_tokens == len(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("prefix,squeeze", [(True, True), (False, False), (False, True)])
def test_normaliser_follows_the_character_map(rule, prefix, squeeze):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    spec = proto.normalizer_spec
    spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = prefix, squeeze, True
    library = sentencepiece.SentencePieceNormalizer(
        model_proto=proto.SerializeToString(), add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    own = pieces.Normaliser(spec, [])
    for text in ("  Ｈello　 wörld ﬁ ½ ①  \t\n x ", "", "   ", "ǅ Ω Å가각 é ㍿", "a"):
        out, source = own(text.encode())
        assert out.decode() == library.normalize(text)
        assert len(source) == len(out) + 1 and (np.diff(source) >= 0).all() and (not len(out) or source[-1] <= len(text.encode()))


def labels(spark, rows, columns="quality int, toxic int"):
    return spark.createDataFrame([(i, *v) for i, v in rows], "doc_id long, " + columns)


def test_quality_rules(spark, rows):
    rng = random.Random(2)
    junk = lambda: "\n".join(" | ".join(f"j{rng.randrange(999)}" for _ in range(12)) for _ in range(10))
    prose = lambda: "\n".join(" ".join(f"word{rng.randrange(999)}" for _ in range(12)) + "." for _ in range(10))
    more = [(1000 + i, junk() if i % 2 else prose(), "s") for i in range(60)]
    known = labels(spark, [(i, (int(i % 2 == 0), 0)) for i, _, _ in more[:40]] + [(None, (1, 0)), (1041, (None, 0))])
    docs = table(spark, [*rows, *more])
    got = {r.doc_id: r for r in line_quality.line_quality(docs, known).collect()}
    for i, t, _ in [*rows, *more]:
        w, t = words_of(t), t or ""
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), failed)
        assert not (failed and got[i].kept)
    assert all(got[i].kept == (i % 2 == 0) for i, _, _ in more[40:])
    kept = line_quality.keep_good(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_viterbi_and_training_against_enumeration():
    rng = np.random.default_rng(0)
    model = Crf(np.zeros(2), np.ones(2), rng.normal(size=2), 0.1, rng.normal(size=(2, 2)), rng.normal(size=2))
    x, lengths = rng.normal(size=(12, 2)), np.array([5, 0, 1, 6])
    got, at = model.viterbi(x, lengths), 0
    for n in lengths:
        s = model.emit(x[at : at + n])
        score = lambda y: sum(s[k] * y[k] for k in range(n)) + model.first[y[0]] + sum(model.move[y[k - 1], y[k]] for k in range(1, n))  # noqa: B023, E731
        if n:
            best = max((tuple((c >> k) & 1 for k in range(n)) for c in range(1 << n)), key=score)
            assert tuple(got[at : at + n]) == best
        at += n
    xs = [rng.normal(size=(20, 1)) for _ in range(50)]
    fitted = train(xs, [(x[:, 0] > 0).astype(int) for x in xs])
    held = rng.normal(size=(200, 1))
    assert (fitted.viterbi(held, np.array([200])) == (held[:, 0] > 0)).mean() > 0.95


def test_toxicity(spark):
    rng = random.Random(4)
    text = lambda bad: " ".join([f"word{rng.randrange(3000)}" for _ in range(60)] + (rng.choices(["scoundrel", "villain"], k=2) if bad else []))
    rows = [(i, text(i % 5 == 0), "s") for i in range(400)]
    known = labels(spark, [(i, (1, int(i % 5 == 0))) for i, _, _ in rows] + [(None, (1, 1)), (3, (1, None))])
    tricky = [(900, "you sc0undrel", "s"), (901, "ѕсоundrel here", "s"), (902, "ＶＩＬＬＡＩＮ!", "s"), (903, None, "s"), (904, "", "s"), (905, "harmless words " * 9000, "s")]
    docs = table(spark, [*rows, *tricky, rows[0]])
    got = toxicity.toxicity(docs, known).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(tricky) + 1 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in held) and held
    assert [by[i].predicted for i in (900, 901, 902, 903, 904, 905)] == [1, 1, 1, 0, 0, 0]
    lexicon = toxicity.Lexicon({"tras": 5.0, "clown\x00": 4.0})
    automaton = lexicon.automaton()
    assert toxicity.evidence("a trash can", automaton) == 0 < toxicity.evidence("trash", automaton)
    assert toxicity.evidence("clowns", automaton) == 0 and toxicity.evidence("mistrash", automaton) == 0


def test_toxicity_keeps_beginnings_beside_whole_words_and_the_heaviest_terms(spark):
    automaton = toxicity.Lexicon({"troll": 3.0, "troll\x00": 4.5}).automaton()
    assert toxicity.evidence("troll", automaton) > toxicity.evidence("trolling", automaton) > 0
    rows = [(i, "abcd zzzzzz" if i < 100 else "abcd" if i < 104 else "ok", "s") for i in range(500)]
    known = labels(spark, [(i, (1, int(i < 100))) for i, _, _ in rows])
    assert list(toxicity.learn(table(spark, rows), known, max_terms=1).weights) == ["zzzz"]


def test_license_scan(spark):
    filler = " ".join(f"f{i}" for i in range(300))
    mit = licenses.TEMPLATES["mit"]
    changed = mit.split()
    changed[40] = "changed"
    half = " ".join(mit.split()[:40])
    rows = [(1, f"{filler} {mit.upper()} {filler}", "s"), (2, f"{filler} {' '.join(changed)}", "s"), (3, half, "s"), (4, None, "s"), (5, "", "s"), (6, "released UNDER the MIT license", "s"),
            (7, filler, "s"), (1, f"{filler} {mit.upper()} {filler}", "s"), (None, licenses.TEMPLATES["gpl-3.0"], "s")]
    got = {(r.doc_id, r.license): r for r in licenses.license_scan(table(spark, rows)).collect()}
    assert set(got) == {(1, "mit"), (2, "mit"), (6, "mit-notice"), (None, "gpl-3.0")}
    assert got[1, "mit"].containment == 1.0 and 0.8 <= got[2, "mit"].containment < 1.0
    assert got[2, "mit"].n_found == got[2, "mit"].n_template - 5


PAGE = ("<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class='ad'>Buy {0} now.</div>"
        "<article><h1>About {0}</h1><p><b>The {0} is a thing that one may look at, and it stays where it is.<br>It is big&nbsp;&amp; old.<p>Many have written of it, at length, and with care.</p>"
        "</article><footer>&copy; {0} &middot; all rights reserved</footer></body></html>")


def test_html_extraction(spark):
    pages = [(i, f"u{i}", PAGE.format(f"thing{i}")) for i in range(40)]
    pages += [(50, "u", None), (51, "u", ""), (52, "u", "<p></p><!-- x -->"), (53, "u", "<div class='menu'><a href=x>A</a>"), (None, "u", pages[0][2]), (0, "u0", pages[0][2])]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = html_blocks.extract_pages(df).collect()
    assert len(got) == len(pages)
    for r in got:
        if r.page_id is None or r.page_id < 40:
            k = f"thing{r.page_id or 0}"
            assert r.text == f"About {k}\n\nThe {k} is a thing that one may look at, and it stays where it is. It is big & old.\n\nMany have written of it, at length, and with care."
        elif r.page_id < 53:
            assert r.text == ""


def test_blocks_go_on_after_elements_without_an_end():
    texts = lambda page: [b.text for b in html_blocks.blocks(page)]
    for tag in "svg select object canvas audio video noscript template iframe".split():
        assert texts(f"<p>one <{tag} class='x'> two</p><p>three</p>") == ["one two", "three"]
        assert texts(f"<p>one <{tag}>no</{tag}> two</p>") == ["one two"]
    for tag in ("script", "style", "textarea", "title"):
        assert texts(f"<p>one <{tag}> two</p><p>three</p>") == ["one"]
    assert texts("<p>let <math><mi>x</mi></math> be</p>") == ["let x be"]
    assert texts("<div><button>OK</button>Text <label>Name</label>more</div>") == ["OK", "Text", "Name", "more"]


def test_page_field_on_held_out_markup():
    def data(numbers):
        out = []
        for i in numbers:
            for variant in html_blocks.labelled(PAGE.format(f"thing{i}"), i):
                known = [(b, int(y)) for b in html_blocks.blocks(variant) if (y := next((s[2] for s in reversed(b.stack) if s[2]), None))]
                out.append((html_blocks.features([b for b, _ in known]), np.array([y for _, y in known])))
        return out

    model = train(*zip(*data(range(150))), ridge=1e-4)
    held = data(range(1000, 1040))
    got = model.viterbi(np.concatenate([x for x, _ in held]), np.array([len(x) for x, _ in held]))
    assert (got == np.concatenate([y for _, y in held])).mean() > 0.95


def test_empty_tables(spark):
    docs, none = table(spark, []), labels(spark, [])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        ngram_join.ngram_components(docs), ngram_join.without_near_copies(docs), substring.dedup_substrings(docs), line_windows.with_lines_removed(docs),
        mixing.mixed(docs), order_minhash.edit_probe(docs), order_minhash.fingerprints(docs), pieces.digests(docs, pieces.public_model()),
        line_quality.line_quality(docs, none), line_quality.keep_good(docs, none), toxicity.toxicity(docs, none), licenses.license_scan(docs), html_blocks.extract_pages(pages),
    ):
        assert out.collect() == []
