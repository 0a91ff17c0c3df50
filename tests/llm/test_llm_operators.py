"""The training-data operators against brute force, exact round trips and defined edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ragspark.llm import bpe, chat, html_text, maxscore, media, mixing, near_dedup, quality, tokenfile, warc
from ragspark.llm.workspace import Workspace

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} Été{i}" for i in range(30_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a b c d"), (6, "A b C d"), (4, "a"), (7, LONG), (8, LONG + " x"), (None, "no id at all here"), (9, "x" * 70_000), (10, "é" * 9)]
CLASHES = ("kept", "component_id", "key", "digest", "n", "size", "target", "score", "ids", "start", "payload", "rank", "_copies")


def documents(spark, rows=None):
    rows = TEXTS if rows is None else rows
    d = spark.createDataFrame([(i, t, "en", None if i == 10 else f"s{(i or 0) % 2}") for i, t in rows], "doc_id long, text string, lang string, source string")
    for c in CLASHES:
        d = d.withColumn(c, F.lit("clash"))
    return d


def shingles(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


# 1


def near_copies(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    bases = [rng.sample(words, rng.randint(20, 160)) for _ in range(6)]
    out = []
    for i in range(n):
        t = list(rng.choice(bases if i % 5 else [rng.sample(words, 30)]))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 8))):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 2)] = [rng.choice(words)]
        out.append((i * 7 % 1009, " ".join(t)))
    return out


@pytest.mark.parametrize("percent,seed", [(80, 1), (85, 2)])
def test_near_duplicates_against_brute_force(spark, percent, seed):
    rows = near_copies(seed)
    want = brute_components(rows, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark, documents(spark, rows), percent).collect()}
    assert got == want


def test_groups_whose_members_are_near_the_threshold(spark):
    """Versions of one text with edits that some of them share: many pairs of a bucket lie on either side of the threshold."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(220)]
    edits = [(rng.randrange(220), f"e{i}") for i in range(40)]
    rows = []
    for i in range(150):
        t = list(base)
        for at, w in rng.sample(edits, rng.randint(2, 9)):
            t[at] = w
        if i % 3 == 0:
            t[rng.randrange(220)] = f"own{i}"
        rows.append((i * 13 % 997, " ".join(t)))
    want = brute_components(rows, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark, documents(spark, rows), 85).collect()}
    assert got == want and 3 < len({c for _, c in want.values()}) < 150


@pytest.mark.parametrize("size", [40, 3000])
def test_bits_lose_no_link(spark, size):
    """The bound by bits holds for all pairs of sets around one, also for sets of many more shingles than bits, and decides pairs
    that the counts alone leave open."""
    rng = random.Random(size)
    draw = lambda k: [rng.getrandbits(64) - (1 << 63) for _ in range(k)]
    base, common = draw(size), draw(size // 2)
    sets = {0: set(base)}
    for i in range(1, 60):
        sets[i] = set(rng.sample(base, size - rng.randrange(size // 5))) | set(rng.sample(common, rng.randrange(size // 8)))
    table = spark.createDataFrame([(i, len(s), sorted(s)) for i, s in sets.items()], "doc_id long, n long, shingles array<long>")
    pairs = table.select(F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b"))
    bits = [*near_dedup._bits(F.array_except("sb", "sa"), "lost"), *near_dedup._bits(F.array_except("sa", "sb"), "gained")]
    met = near_dedup._shared(pairs, table, *bits).withColumnsRenamed({"a": "doc_id", "na": "least", "both": "high"})
    met = met.withColumns({"beyond": F.col("least") - F.col("high"), "own": F.col("least"), "several": F.lit(False)}).drop("b", "nb").cache()
    both = met.crossJoin(met.select(*[F.col(c).alias(f"{c}_2") for c in met.columns])).where("doc_id < doc_id_2")
    got = both.select("doc_id", "doc_id_2", near_dedup._able(80, "", "_2").alias("able"), near_dedup._sharply(80, "_2").alias("sharply")).collect()
    links = {(r.doc_id, r.doc_id_2) for r in got if 100 * len(sets[r.doc_id] & sets[r.doc_id_2]) >= 80 * len(sets[r.doc_id] | sets[r.doc_id_2])}
    assert len(got) == 60 * 59 // 2 and 0 < len(links) < len(got)
    open_, left = ({(r.doc_id, r.doc_id_2) for r in got if r[c]} for c in ("able", "sharply"))
    assert links <= left and left < open_
    met.unpersist()


def test_near_duplicates_of_repeated_ids_near_the_threshold(spark):
    """Rows of one doc_id with several sets are linked each by its own set."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        for at in rng.sample(range(120), rng.randint(0, 6)):
            t[at] = f"e{rng.randrange(25)}"
        rows.append((i % 45, " ".join(t)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, documents(spark, rows), 85).collect()}
    comp = {i: i for i, _ in rows}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if 100 * len(s & t) >= 85 * len(s | t):
                a, b = top(i), top(j)
                comp[max(a, b)] = min(a, b)
    assert got == {i: top(i) for i in comp}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(900, 901)], "a long, b long")
    out = {r.node: r.component for r in near_dedup.components(Workspace(spark, "path-test"), links, "path").collect()}
    assert len(out) == 403 and set(out.values()) == {0, 900}


def test_near_duplicates_of_sets_that_fill_the_circle(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PLACES", 1 << 20)
    words = [f"v{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["x"])), (3, " ".join(f"u{i}" for i in range(60_000)))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, documents(spark, rows), 85).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_near_duplicates_edges(spark):
    out = near_dedup.near_duplicates(spark, documents(spark), 85)
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in out.collect()}
    assert out.count() == len(TEXTS)
    assert got[1, 0] == (1, True) and got[3, 0] == (3, True) and got[4, 1] == (4, True)
    assert got[6, 1] == (5, False) and [v for k, v in got.items() if k[0] == 8] == [(7, False)]
    assert [v for k, v in got.items() if k[0] is None] == [(None, True)]
    assert near_dedup.near_duplicates(spark, documents(spark).where("false"), 85).count() == 0
    kept = near_dedup.keep_one(spark, documents(spark), 85)
    assert kept.columns == documents(spark).columns and kept.count() == len(TEXTS) - 2


def test_circulant_signature_estimates_jaccard():
    made = near_dedup.CirculantMinHash(128)
    a = near_dedup.mix(np.arange(1000, dtype=np.uint64))
    b = near_dedup.mix(np.arange(200, 1200, dtype=np.uint64))
    assert abs((made.signature(a) == made.signature(b)).mean() - 800 / 1200) < 0.15
    k0 = made.windows[5]
    assert (made.windows[6][:-1] == k0[1:]).all()  # the second permutation is shifted by one a coordinate
    for percent in (80, 85, 95):
        bands, rows = near_dedup.bands_and_rows(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= near_dedup.MISS * 1.0001


# 2


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(TOKENIZER)
    tok.no_truncation()
    tok.no_padding()
    return tok


@pytest.fixture(scope="module")
def coder():
    return bpe.loaded(bpe.read_spec(TOKENIZER))


ODD = st.lists(st.sampled_from(["a", "th", "ing", "é", "Σ", "İ", "ﬁ", "<|endoftext|>", "<|", " ", "\n", "\x1c", "\x85", "\xa0", "1", "²", "'s", "'LL", "!!", "漢字", "가", "́", "😀", "_", "K"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(ODD, st.text(max_size=60)))
def test_encoding_equals_the_library(library, coder, text):
    encoder, decoder = coder
    want = library.encode(text, add_special_tokens=False).ids
    ids = np.frombuffer(next(encoder.encode([text])), encoder.kind)
    assert ids.tolist() == want
    assert decoder.feed(ids[:3]) + decoder.feed(ids[3:]) + decoder.finish() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["a", "ab", "theinganer", "abcdefghijklmnopqrstuvwxyz", "!?*"])
def test_streaming_emits_what_the_whole_word_gives(library, coder, letters):
    rng = random.Random(letters)
    word = "".join(rng.choice(letters) for _ in range(9000))
    want = library.encode(word, add_special_tokens=False).ids
    merges = coder[0].merges
    symbols = merges.inner[np.frombuffer(word.encode() * 2, np.uint8)]
    symbols[[len(word) - 1, -1]] = merges.last[ord(word[-1])]
    both, at = merges.transduce(symbols, np.array([0, len(word)]), merges.lookahead + 50)
    assert both.tolist() == want * 2 and at.tolist() == [0, len(want)]
    machine, got = bpe.Transducer(merges, merges.lookahead + 50), []
    for i in range(0, len(word), 41):
        got += [x for part in machine.feed(word[i : i + 41].encode()) for x in part.tolist()]
        assert len(machine.held) <= machine.window + 41
    assert got + machine.finish().tolist() == want


def test_all_words_pass_the_transducer(library, monkeypatch):
    encoder = bpe.Encoder(__import__("json").loads(bpe.read_spec(TOKENIZER)))
    rng = random.Random(5)
    words = ["".join(rng.choice("theinganer'é漢1!") for _ in range(rng.choice((3, 9, 300, 5000)))) for _ in range(60)] + ["don't", "ﬁn", "a" * 9000]
    plain, seen = bpe.MergeList.transduce, []
    narrow = encoder.merges.lookahead + 40
    monkeypatch.setattr(bpe.MergeList, "transduce", lambda self, ids, starts, window=None: seen.append(len(starts)) or plain(self, ids, starts, narrow))
    monkeypatch.setattr(bpe, "GROUP_CHARS", 6000)  # the longest words stream by themselves
    for w in words:
        got = np.frombuffer(next(encoder.encode([w])), encoder.kind)
        assert got.tolist() == library.encode(w, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "GROUP_CHARS", 2_000_000)
    encoder.words, encoder.older, seen[:] = {"": b""}, {}, []
    raw = next(encoder.encode([" ".join(words)]))
    assert np.frombuffer(raw, encoder.kind).tolist() == library.encode(" ".join(words), add_special_tokens=False).ids and sum(seen) >= len(set(words))


def test_byte_level_decoder_is_incremental():
    spec = {"model": {"vocab": {c: i for i, c in enumerate(bpe.byte_letters())}}, "decoder": {"type": "ByteLevel"}}
    d = bpe.Decoder(spec)
    ids = np.frombuffer("é漢😀".encode(), np.uint8)
    assert "".join(d.feed(ids[i : i + 1]) for i in range(len(ids))) + d.finish() == "é漢😀"
    assert d.feed(ids[:1]) + d.finish() == "�"


def test_columns_of_ids_and_texts(spark, library):
    encoded = bpe.encode_column(spark, documents(spark).withColumn("width", F.lit("clash")), TOKENIZER, ["doc_id", "lang", "ids", "width"])
    got = sorted(((r.doc_id, r.text) for r in bpe.decode_column(spark, encoded, TOKENIZER, ["doc_id"]).collect()), key=str)
    want = [(i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in TEXTS]
    assert got == sorted(want, key=str)


def test_round_trip_edges(spark, library):
    got = sorted((tuple(r) for r in bpe.round_trip(spark, documents(spark), TOKENIZER).collect()), key=str)
    want = []
    for i, t in TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(spark, documents(spark).where("false"), TOKENIZER).count() == 0


# 3


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<|\\im_endstart>\n é", max_size=60))
def test_escape_is_reversible_and_safe(text):
    import pyarrow as pa

    out = chat.escape(pa.array([text]))[0].as_py()
    assert chat.unescape(out) == text and "<|" not in out


def test_roles_may_hold_line_feeds(spark):
    c = spark.createDataFrame([(1, 1, "a\nb\\n", "x\\n\ny"), (1, 2, "assistant", "\n\\")], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(spark, c).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (out.turns_sha256, out.loss_sha256) == (sha("a\nb\\n\nx\\n\ny\nassistant\n\n\\\n"), sha("\n\\"))


def test_chat(spark):
    rows = [(1, 1, "user", "hi <|im_end|> \\ é"), (1, 2, "assistant", None), (1, 2, "assistant", "yes"), (1, None, "system", "<|im_start|>"), (None, 1, None, "x"), (2, 1, "assistant", "y" * 50_000)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("place", F.lit(1))
    out = {r.conv_id: r for r in chat.format_conversations(spark, chat.with_probe(spark, c)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(out) == {1, 2, None, -1}
    assert out[1].n_turns == 4 and out[1].turns_sha256 == sha("system\n<|im_start|>\nuser\nhi <|im_end|> \\ é\nassistant\n\nassistant\nyes\n")
    assert (out[1].loss_chars, out[1].loss_sha256) == (3, sha("yes")) and out[2].loss_chars == 50_000
    assert out[-1].n_turns == 2 and out[-1].loss_sha256 == sha(chat.PROBE)
    assert chat.format_conversations(spark, c.where("false")).count() == 0


# 4


def test_warc(spark):
    big, other = "é" * 700, "x" * 2000
    rows = [(1, "u", big), (5, None, big), (3, "a\r\nWARC-Type: evil", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", other), (7, "u", other), (8, "u", ""), (None, "u", big)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("body", F.lit(2))
    ws = Workspace(spark, "warc-test")
    records, payloads = warc.write_archive(spark, p, ws)
    assert payloads.count() == 4  # each distinct payload once
    out = sorted((tuple(r) for r in warc.read_archive(records, payloads, ws).collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        holder = max((j for j, _, g in rows if j is not None and g == h), default=None)
        again = len(b) >= 1000 and i is not None and i < holder
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", holder if again else None))
    assert out == sorted(want, key=str)
    whole = warc.original_records(records, payloads).collect()
    names = set()
    for r in whole:  # each record stands for itself: WARC header, block of the length it says, two line ends
        raw = bytes(r.record)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        assert raw.startswith(b"WARC/1.1\r\n") and rest[len(block) :] == b"\r\n\r\n" and fields["WARC-Target-URI"]
        names.add(fields["WARC-Record-ID"])
        if r.page_id == 5:
            assert block.partition(b"\r\n\r\n")[2] == big.encode() and fields["WARC-Type"] == "response"
        if r.page_id == 1:
            assert block.endswith(b"\r\n\r\n") and fields["WARC-Refers-To"].startswith("<urn:page:5:")
    assert len(names) == len(rows)
    key, other_z = hashlib.sha256(other.encode()).hexdigest(), __import__("zstandard").ZstdCompressor().compress(b"no")
    bad = payloads.withColumn("z", F.when(F.col("key") == key, F.lit(other_z)).otherwise(F.col("z")))
    for broken in (bad, payloads.where(F.col("key") != key)):
        with pytest.raises(Exception, match="does not match"):
            warc.read_archive(records, broken, ws).collect()
    cut = records.withColumn("header", F.when(F.col("page_id") == 2, F.regexp_replace(F.decode("header", "UTF-8"), "Content-Length: \\d+", "Content-Length: 1").cast("binary")).otherwise(F.col("header")))
    with pytest.raises(Exception, match="not as long"):
        warc.read_archive(cut, payloads, ws).collect()
    assert warc.archive_round_trip(spark, p.where("false")).count() == 0


def test_warc_takes_very_long_pages(spark):
    p = spark.createDataFrame([(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in warc.archive_round_trip(spark, p).collect()) == [(1, 6_000_000, 2), (2, 6_000_000, None)]


# 5


def brute_top(x, i, k=5):
    return sorted(((int(np.dot(x[i].astype(object), x[j].astype(object))), -j) for j in range(len(x)) if j != i), reverse=True)[:k]


@pytest.mark.parametrize("kind", ["dense", "sparse", "clusters", "ties", "equal"])
def test_maxscore_splits_its_terms(kind):
    rng = np.random.default_rng(7)
    x = {
        "dense": lambda: rng.integers(-50, 50, (900, 12)),
        "sparse": lambda: np.where(rng.random((900, 60)) < 0.05, rng.integers(1, 40, (900, 60)), 0),
        "clusters": lambda: rng.integers(-40, 40, (6, 32))[rng.integers(0, 6, 900)] * 3 + rng.integers(-9, 9, (900, 32)),
        "ties": lambda: rng.integers(0, 2, (900, 6)),
        "equal": lambda: np.ones((900, 4), np.int64),
    }[kind]().astype(np.float64)
    shard = maxscore.MaxScore(np.arange(900), x)
    for i in range(0, 900, 37):
        s, ids = shard.search(i, x[i], 5)
        assert [(int(a), -int(b)) for a, b in zip(s, ids)] == brute_top(x, i)
    if kind in ("sparse", "clusters"):
        assert shard.seen["nonessential"] and shard.seen["spared"] > shard.seen["probed"]
    if kind == "sparse":
        assert shard.seen["skipped"] > shard.seen["traversed"]


def test_maxscore_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 64)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 8)), 1).tolist()
    x[20] = x[10]
    x[3], x[4], x[5], x[6] = None, [float("nan")] + x[4][1:], [None] + x[5][1:], x[6][:5]
    x[7] = [1e7] * 8
    v = spark.createDataFrame(list(enumerate(x)) + [(None, x[8])], "vec_id long, embedding array<double>").withColumn("shard", F.lit(0)).withColumn("score", F.lit("z"))
    got = {}
    for r in maxscore.top_k(spark, v.where("vec_id % 50 = 0"), v, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    q = {i: [int(np.floor(256 * c)) for c in e] for i, e in enumerate(x) if e is not None and all(c is not None and np.isfinite(c) for c in e)}
    for i in range(0, 300, 50):
        s = sorted(((sum(a * b for a, b in zip(q[i], q[j])), -j) for j in q if j != i), reverse=True)[:5]
        assert got[i] == [(-j, t) for t, j in s]
    assert maxscore.top_k(spark, v.where("false"), v).count() == 0 and maxscore.top_k(spark, v, v.where("false")).count() == 0


# 6


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=120), min_size=1, max_size=8), st.integers(2, 9))
def test_blocks_decode_whole_and_in_part(docs, least):
    parts = [np.array(d, np.int64) for d in docs]
    block = tokenfile.Block(tokenfile.write_block(list(range(len(parts))), parts, least))
    flat = [x for d in docs for x in d]
    assert block.all().tolist() == flat
    for i, d in enumerate(docs):
        assert block.document(i).tolist() == d
    assert block.range(len(flat) // 3, len(flat) // 2).tolist() == flat[len(flat) // 3 : len(flat) // 2]
    symbols = block.symbols.tolist()
    assert max([0, *non_overlapping(symbols).values()]) < least  # no pair is left that pays for a rule


def non_overlapping(symbols):
    count, last = {}, {}
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if last.get(pair) != i - 1:
            count[pair], last[pair] = count.get(pair, 0) + 1, i
    return count


def test_repair_compresses_repetition_and_expands_only_what_is_asked(monkeypatch):
    ids = np.tile(np.arange(50), 400)
    symbols, rules, rounds, alphabet = tokenfile.compress(ids)
    assert len(symbols) < len(ids) / 100 and sum(rounds) == len(rules) and alphabet.tolist() == list(range(50))
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 60_000) % 900
    block = tokenfile.Block(tokenfile.write_block([1], [ids]))
    assert (block.all() == ids).all() and max(non_overlapping(block.symbols.tolist()).values()) < tokenfile.LEAST
    asked, plain = [], tokenfile.Grammar.expand
    monkeypatch.setattr(tokenfile.Grammar, "expand", lambda self, s: asked.append(len(s)) or plain(self, s))
    assert (block.range(30_000, 30_100) == ids[30_000:30_100]).all() and max(asked) <= 101


def test_most_frequent_pair_goes_first():
    _, rules, _, alphabet = tokenfile.compress(np.array([1, 2, 3] * 5 + [1, 2, 9] * 20), 5)
    assert alphabet[rules[0]].tolist() == [1, 2]


def test_token_files(spark, library, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_IDS", 1000)
    at, want = 0, []
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in tokenfile.token_files(spark, documents(spark).repartition(3), TOKENIZER).collect()), key=lambda r: r[1])
    assert got == want
    assert tokenfile.token_files(spark, documents(spark).where("false"), TOKENIZER).count() == 0


# 7

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="ad">Buy</div>
<main><article><h1>Head &amp; line</h1><p><b>One<br><p>Be.</p><div class='cookie-notice'>We use</div><p>Two&nbsp;
 words &lt;3</p><form><input>Mail</form><aside>Side</aside><ul><li>Item</li></ul><section id="comments"><p>Reader</p></section></article></main>
<footer>Foot</footer></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Head & line\nOne\nBe.\nTwo words <3\nItem"
    long = "<p>" + "word " * 60 + "</p>"
    loose = f"<div class=menu><a href=1>x</a></div><div>{long}<p>Short.</p>{long}</div><div class='footer'>end</div>"
    assert html_text.main_text(loose).split("\n")[1] == "Short."
    for text in (None, "", "<nav>only</nav>", "<script>x", "<!-- open"):
        assert html_text.main_text(text) == ""
    p = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract(spark, p).collect()
    assert [r.n_chars for r in out] == [len(html_text.main_text(PAGE))] * 2 + [0]
    assert html_text.extract(spark, p.where("false")).count() == 0


@pytest.mark.parametrize("wrapper", ['<div class="content has-sidebar">', '<div id="page-with-comments">', '<div class="no-header">', '<div class="widget">', '<form id="search">', "<header>"])
def test_html_wrappers(wrapper):
    name = wrapper[1:].split()[0].rstrip(">")
    for kind in ("article", "main"):
        assert html_text.main_text(f"{wrapper}<div class=sidebar>Side</div><{kind}><h1>T</h1><p>Text</p></{kind}></{name}><div class=comments><article>Reader</article></div>") == "T\nText"
    assert html_text.main_text(f"{wrapper}<h1><a href=1>T</a></h1><p>Text</p></{name}>") == "T\nText"


def test_html_sections_of_an_article():
    for i in ("discussion", "related-work", "search", "notices"):
        assert html_text.main_text(f'<article><h2 id="{i}">H</h2><section id="{i}"><p>S</p></section><div class="ad">Ad</div></article>') == "H\nS"


def test_html_first_and_last_passages_around_adverts():
    for size in (2_000, 30_000):
        page = f"<h1>Title</h1><div class=ad>Ad</div><p>One.</p><div class=ad>Ad</div><p>{'x' * size}</p><form>Mail</form><p>End.</p><ul><li><a href=1>Menu</a></ul>"
        assert html_text.main_text(page.replace("<ul>", "<aside>Side</aside><ul>")) == f"Title\nOne.\n{'x' * size}\nEnd."


def test_surge_and_dive():
    assert html_text.passages(np.array([0, 5, 0, 7, 0, 0, 0, 9])) == [(1, 4, 12), (7, 8, 9)]


def test_regions_below_the_bar_are_not_text():
    long = "<p>" + "word " * 60 + "</p>"
    text = " ".join(["word"] * 60)
    assert html_text.main_text(f"<div>Slogan</div><nav>x</nav>{long}<p>End.</p><footer>f</footer><div>Imprint</div>") == f"{text}\nEnd."
    assert html_text.main_text(f"<article><p>Teaser</p></article><nav>x</nav><div>{long}</div>") == text
    assert html_text.main_text(f"<div>Slogan</div><article><h1>T</h1>{long}<aside>Side</aside><p>End.</p></article>") == f"T\n{text}\nEnd."
    assert html_text.main_text("<article><p>Only this.</p></article>") == "Only this."


def test_names_that_only_contain_a_noise_word_stay():
    page = '<article><p>One</p><p class="related-work">Two</p><div class="notice-period"><p>Three</p></div><section id="search-results-analysis"><p>Four</p></section><p>Five</p></article>'
    assert html_text.main_text(page) == "One\nTwo\nThree\nFour\nFive"


def test_all_pages_against_a_plain_version(data):
    """The test pages' blocks, cut out by plain patterns."""
    import html
    import re

    import pyarrow.parquet as pq

    for r in pq.read_table(f"{data}/pages.parquet").to_pylist():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:h1|p|div|ul|li|section)[^>]*>", re.sub("</?b>", "", inner))]
        assert html_text.main_text(r["html"]) == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("part", ["<form>", '<a href="x>y', "<div class='ad'>", "<!", "<article>", "<a ", "<script>", "&amp", "<p>x</p><div class=ad>"])
def test_hostile_pages_take_linear_time(part):
    import time

    html_text.main_text(part)
    began = time.process_time()
    html_text.main_text(part * 100_000)
    assert time.process_time() - began < 5


# 8


def test_cuts_follow_the_content():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 300_000, np.uint8).tobytes()
    a, b = media.chunks(data), media.chunks(b"inserted" + data)
    assert b"".join(a) == data and max(map(len, a)) <= media.MAX and min(map(len, a[:-1])) >= media.MIN
    assert len(set(a) & set(b)) >= len(a) - 3
    assert media.chunks(b"") == [b""]


def plain_cuts(payload):
    """Byte by byte, without blocks."""
    table, out, begin, h, bound = media._GEAR.tolist(), [], 0, 0, 1 << (64 - media.CUT_BITS)
    for i, byte in enumerate(payload, 1):
        h = (h * 2 + table[byte]) % (1 << 64)
        if i - begin >= media.MIN and h < bound or i - begin == media.MAX:
            out.append(i)
            begin = i
    return out if out and out[-1] == len(payload) else [*out, len(payload)]


def test_cuts_are_those_of_a_plain_rolling_hash(monkeypatch):
    monkeypatch.setattr(media, "HASHED", 10_000)
    rng = np.random.default_rng(3)
    for n in (0, 1, 4096, 4097, 70_000, 200_000):
        for data in (rng.integers(0, 256, n, np.uint8).tobytes(), b"z" * n):
            assert media.cuts(data) == plain_cuts(data)


def test_media(spark):
    got = {}
    for r in media.store_media(spark, documents(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(TEXTS)
    pack = __import__("zstandard").ZstdCompressor(level=media.LEVEL, write_checksum=False)
    for i, t in TEXTS:
        n, payload = media.payload_of(t)
        ends = plain_cuts(payload)
        parts = [payload[a:z] for a, z in zip([0, *ends[:-1]], ends)]
        form = b"".join(map(pack.compress, parts)) + b"".join(hashlib.sha256(p).digest() + len(p).to_bytes(4, "little") for p in parts) + len(parts).to_bytes(4, "little") + len(payload).to_bytes(8, "little") + b"CDC1"
        x = list(payload)
        above = [v >= 128 for v in x]
        feature = f"mean={sum(x) / len(x):.6f};power={sum(v * v for v in x) / len(x):.6f};low={min(x)};high={max(x)};values={len(set(x))};crossings={sum(a != b for a, b in zip(above, above[1:]))}"
        for r in got[i]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            if len(got[i]) == 1 or i == 4:
                assert (r.media_bytes, r.media_sha256, r.feature) == (len(form), hashlib.sha256(form).hexdigest(), feature)
    same = lambda i: {(r.media_bytes, r.media_sha256, r.feature) for r in got[i]}
    assert same(1) == same(2) and len(same(4)) == 1 and same(7) != same(8)
    assert media.store_media(spark, documents(spark).where("false")).count() == 0


def test_media_finds_a_wrong_list(spark):
    rows = documents(spark).select("doc_id", "text")
    listed, store = media.manifests(rows), media.stored_chunks(rows).cache()
    one, many = media.rebuilt(listed, store)
    assert {bytes(r.again) for r in one.unionByName(many).collect()} >= {hashlib.sha256(r.trailer).digest()[:8] for r in listed.collect()}
    with pytest.raises(Exception, match="does not match its digest"):
        media.rebuilt(listed, store.withColumn("digest", F.concat(F.lit(b"x"), F.substring("digest", 2, 31))))[0].collect()


# 9


def test_quality(spark, data):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.quality_scores(spark, docs, labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and ((out.score >= 0) & (out.score <= 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(out.doc_id, out.held_out))


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(spark, documents(spark), labels).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    none = quality.quality_scores(spark, documents(spark), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.keep_good(spark, documents(spark), labels).columns == documents(spark).columns
    assert quality.quality_scores(spark, documents(spark).where("false"), labels).count() == 0


def test_hinge_fit_separates_and_ignores_order():
    good, bad = quality.features("A fine text. It goes on and on."), quality.features("X## Y## Z## W##")
    m = quality.fit([good, bad] * 5, np.array([1, -1] * 5))
    assert m.score(good) > 0.5 > m.score(bad)


def test_all_of_a_text_without_spaces_counts():
    start = "天地玄黄宇宙洪荒" * 9
    for good, bad in (("日月盈昃辰宿列张", "寒来暑往秋收冬藏"), ("abcdefgh", "qrstuvwx"), ("ab,cd.", "#1$2%3")):
        clean, junk = quality.features(start + good * 40), quality.features(start + bad * 40)
        m = quality.fit([clean, junk] * 5, np.array([1, -1] * 5))
        assert m.score(clean) > 0.5 > m.score(junk)
    late = "aB3-" * 5
    assert not np.array_equal(quality.features(late + "x9x9"), quality.features(late + "--==")) and quality.features("fine words").tolist() != quality.features("poor words").tolist()


# 10


def fill(sizes, weights, total):
    """Iterative resharing."""
    target, left, open_ = [0.0] * len(sizes), total, set(range(len(sizes)))
    while open_ and left > 1e-9:
        w = sum(weights[i] for i in open_)
        add = {i: left * weights[i] / w for i in open_}
        left = 0.0
        for i in list(open_):
            target[i] += add[i]
            if target[i] >= 2 * sizes[i]:
                left += target[i] - 2 * sizes[i]
                target[i] = 2.0 * sizes[i]
                open_.discard(i)
    return target


def test_mixing(spark):
    rng = random.Random(5)
    names = [None, "a", "b", "ä", "B", "z"]
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(int(rng.expovariate(1 / 60)))), names[min(5, int(rng.expovariate(0.6)))]) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    out = mixing.mix(spark, d).toPandas()
    again = mixing.mix(spark, d.repartition(5)).toPandas()
    key = lambda f: sorted(map(tuple, f.values.tolist()))
    assert key(out) == key(again)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    assert all(size[i] == s for i, s in zip(out.doc_id, out["size"])) and (out.taken <= 2 * out["size"]).all()
    order = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(size[i] for i, _, s in rows if s == x) for x in order]
    want = dict(zip(order, fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes))))
    source = {i: s for i, _, s in rows}
    out["source"] = out.doc_id.map(source)
    for x in order:
        part = out[out.source.isna()] if x is None else out[out.source == x]
        assert part.target.iloc[0] == pytest.approx(want[x], rel=1e-9)
        assert abs(part.taken.sum() - want[x]) <= part["size"].max()


def test_rates_tilt_exponentially_and_meet_their_targets(spark):
    """The Newton iterations against a plain bisection of the dual."""
    rng = random.Random(8)
    rows = [(i, "w " * int(rng.expovariate(1 / 40)), "abc"[i % 7 % 3]) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ws = Workspace(spark, "mixing-test")
    planned = {r._source: r for r in mixing.plan(spark, mixing._prepared(d, ws)[0], ws).collect()}
    for source, r in planned.items():
        sizes = [len(t.split()) for _, t, s in rows if s == source]
        mean = sum(sizes) / len(sizes)
        mass = lambda x: sum(n * min(2.0, np.exp(min(x * n / mean, 1.0))) for n in sizes)  # noqa: B023, E731
        if r.target < 2 * sum(sizes) * (1 - 1e-12):
            lo, hi = -1e4, 1e4
            for _ in range(200):
                lo, hi = ((lo + hi) / 2, hi) if mass((lo + hi) / 2) < r.target else (lo, (lo + hi) / 2)
            assert r._lambda == pytest.approx(lo, rel=1e-6, abs=1e-9) and mass(r._lambda) == pytest.approx(r.target, rel=1e-6)


def test_mixing_spreads_ties(spark):
    text = " ".join(["w"] * 100)
    d = spark.createDataFrame([(None, text, "a")] * 100 + [(5, text, "b")] * 90 + [(None, text + " x", "b")] * 7 + [(i, "w", None) for i in range(9)], "doc_id long, text string, source string")
    out = mixing.mix(spark, d.repartition(3)).toPandas()
    for size in out.source_size.unique():
        part = out[out.source_size == size]
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max() / 2 + 1e-9
    again = mixing.mix(spark, d.coalesce(1)).toPandas()
    key = lambda f: sorted(map(str, f.values.tolist()))
    assert key(out) == key(again)
    assert mixing.mixed_documents(spark, d.repartition(2)).count() == sum(out.taken // out["size"])


def test_mixing_edges(spark):
    out = mixing.mix(spark, documents(spark)).collect()
    assert len(out) == len(TEXTS) and all(r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0 for r in out)
    assert mixing.mix(spark, documents(spark).where("false")).count() == 0
    made = mixing.mixed_documents(spark, documents(spark))
    assert made.columns == documents(spark).columns and made.count() >= 1
