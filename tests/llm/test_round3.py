"""Source mix, filter audit, conversation repair, and words that collide by construction, against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import conversations, encoder, exact_dedup, filter_audit, minhash, mixing, packing, substring_dedup, token_store, words
from riskloom.llm.common import scratch_path

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, part string, key string, size int, n int, digest string, failed int, place int, target double"
TURNS = "conv_id long, turn long, role string, text string, part int, number int, digest string, audit string, n int"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "p", "k", 1, 2, "d", 3, 4, 0.5) for i, t, s in rows], DOCS)


def tuples(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def thue_morse(n, a="a", b="b"):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_words_that_collide_in_polynomials_differ(n):
    data = np.frombuffer(f"{thue_morse(n)} {thue_morse(n, 'b', 'a')} {thue_morse(n)}".encode(), np.uint8)
    starts, ends, _ = words.word_spans(data, np.array([0, len(data)]))
    h = words.word_hashes(data, starts, ends, False)
    assert h[0] != h[1] and h[0] == h[2]
    pad = words.padded(data)
    assert words.same_words(pad, starts[[0, 0]], ends[[0, 0]], pad, starts[[1, 2]], ends[[1, 2]]).tolist() == [False, True]


def test_operators_tell_colliding_words_apart(spark):
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    filler = " ".join(f"w{i}" for i in range(19))
    rows = [(1, one, "s"), (2, two, "s"), (3, f"{filler} {one}", "s"), (4, f"{filler} {two}", "s")]
    docs = docs_of(spark, rows)
    assert tuples(minhash.near_duplicates(docs), "doc_id", "component_id") == [(1, 1), (2, 2), (3, 3), (4, 3)]  # the last two share 15 of 17 shingles
    assert tuples(substring_dedup.substring_dedup(docs), "doc_id", "n_removed") == [(i, 0) for i in (1, 2, 3, 4)]
    library = encoder.WordEncoder.get(PATH).tokenizer
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t, _ in rows}
    out = scratch_path(spark, "collide")
    token_store.write_token_store(docs, out, PATH, 2)
    crc = {i: zlib.crc32(np.array(ids + [2], "<u4").tobytes()) for i, ids in want.items()}
    assert tuples(token_store.read_token_store(spark, out), "doc_id", "ids_crc32") == sorted(crc.items())
    packed = {r["doc_id"]: r["ids_crc32"] for r in packing.pack(docs, PATH, 4096, 1).collect()}
    assert packed == {i: zlib.crc32(np.array(ids + [1], "<u4").tobytes()) for i, ids in want.items()}


def test_encoder_is_right_where_hashes_collide(monkeypatch):
    """With eight hash values only, nearly all words collide; ids stay those of the library."""
    plain = encoder.word_hashes
    monkeypatch.setattr(encoder, "word_hashes", lambda *a, **k: plain(*a, **k) % np.uint64(8))
    e = encoder.WordEncoder(PATH)
    texts = ["some words are here", "and others, too", "", None, "x" * 90 + " y", "words are here again"] * 3
    for t, ids in zip(texts, encoder.encoded(pa.array(texts), e), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


# source mix


def test_targets_share_what_is_above():
    def plain(sizes, weights):
        share, held = [0.0] * len(sizes), set()
        while True:
            rest = sum(sizes) - sum(3 * sizes[i] for i in held)
            total = sum(w for i, w in enumerate(weights) if i not in held)
            share = [3 * s if i in held else rest * w / total for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
            more = {i for i in range(len(sizes)) if i not in held and share[i] > 3 * sizes[i]}
            if not more:
                return share
            held |= more

    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = (rng.pareto(0.6, 9) * 10).astype(int).tolist()
        got = mixing.targets(sizes, [1, 2, 3] * 3)
        assert np.allclose(got, plain(sizes, [1, 2, 3] * 3)) and np.isclose(got.sum(), sum(sizes))


def test_hypergeometric_draws_follow_the_law():
    from math import comb

    good, total, drawn = 7, 30, 12
    n = 20_000
    got = np.bincount([mixing.hypergeometric(good, total, drawn, (i + 0.5) / n) for i in range(n)], minlength=8) / n
    want = [comb(good, k) * comb(total - good, drawn - k) / comb(total, drawn) for k in range(8)]
    assert np.abs(got - want).max() < 1e-3
    big = [mixing.hypergeometric(10**9, 3 * 10**10, 10**10, (i + 0.5) / 200) for i in range(200)]
    assert abs(np.mean(big) - 10**9 / 3) < 3000 and all(0 <= x <= 10**9 for x in big)


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_shards_split_the_quotas(shards):
    quotas, names = [100, 37, 5, 0, 1000], list("abcde")
    found = [mixing.shard_quotas(quotas, names, s, shards, "x") for s in range(shards)]
    for k, quota in enumerate(quotas):
        at = 0
        for begin, count in found:
            assert begin[k] == at
            at += count[k]
        assert at == quota
    sizes = [sum(c) for _, c in found]
    assert max(sizes) - min(sizes) <= 1 + shards.bit_length()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_blocks_are_permuted(n):
    assert sorted(mixing.permuted(np.arange(n), n, 99).tolist()) == list(range(n))


def mix_rows():
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(1, 60))), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(600)]
    return rows + [(1000, None, "empty"), (1001, "", "empty"), (1002, "a b c", None), (1003, "long " * 40_000, "huge"), (5, rows[5][1], rows[5][2]), (5, "other text", "s5"), (None, "no id", "s1")]


def test_source_mix(spark):
    rows = mix_rows()
    docs = docs_of(spark, rows).repartition(5)
    got = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(3)).collect())) if None not in [r[0] for r in got] else True
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))]), strict=True))
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _ in rows)
    source = {(i, len(WORD.findall(t or ""))): s for i, t, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and np.isclose(r["target"], goal[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(2, 0.01 * goal[s])


def test_source_mix_reruns_agree_and_shards_are_disjoint(spark):
    docs = docs_of(spark, [r for r in mix_rows() if r[0] is not None])
    pull = lambda d: sorted((r["doc_id"], r["size"], x["shard"], x["slot"], x["from"], x["words"]) for r in mixing.draws(d, shards=6).collect() for x in r["draws"])
    first = pull(docs.repartition(4))
    assert first == pull(docs.coalesce(1))
    mixed = mixing.mixture(docs, shards=6)
    for r in mixed.collect():
        assert len(WORD.findall(r["text"])) == r["words"]
    by_shard = dict(mixed.groupBy("shard").agg(F.sum("words").alias("w")).collect())
    assert sum(by_shard.values()) == sum(x[5] for x in first) and max(by_shard.values()) < 1.3 * min(by_shard.values())


def test_source_mix_of_nothing(spark):
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0
    assert tuples(mixing.mix_sources(docs_of(spark, [(1, None, None), (2, " ", "a")])), "doc_id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# filter audit


def brute_failures(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {f for f, bad in {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": t in first and (i is None or i > first[t]),
        }.items() if bad}
        out.append(fails)
    return out


def brute_audit(rows, labels):
    fails, out = brute_failures(rows), []
    good, toxic = ({i for i, *y in labels if y[k] == 1 and i is not None} for k in (0, 1))
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, fails, strict=True) if (s or "") == part]
        lines, total = [], defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                lines.append([part, "".join(order), step, len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)])
        out += [tuple(x + [total[x[1][x[2] - 1]]]) for x in lines]
    return sorted(out)


def audit_rows():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, k, n)) for k, n in ((1000, 300), (20, 300), (1000, 50), (1000, 210))]
    texts += [texts[0] + " COST $5", texts[0].upper(), "É東京 " * 250, "", None, " \t", "A", "x" * 70 + " " + "x" * 70, texts[3]]
    rows = [(i, t, ("a", "b", None)[i % 3]) for i, t in enumerate(texts * 2)]
    return rows + [(3, texts[3], "a"), (3, texts[3], "b"), (None, texts[3], "b"), (None, "only without id", "a"), (None, "only without id", None), (7, texts[1], "")]


def test_filter_audit(spark):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (2, None, None)]
    docs, lab = docs_of(spark, audit_rows()), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert tuples(filter_audit.filter_audit(docs.repartition(3), lab), *"part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()) == brute_audit(audit_rows(), labels)
    assert filter_audit.filter_audit(docs.limit(0), lab).count() == 0
    assert filter_audit.filter_audit(docs, lab.limit(0)).count() == 3 * 600


@pytest.mark.parametrize("limit", [1, 3, 17, 1 << 18])
def test_transducer_in_pieces(limit):
    texts = [t or "" for _, t, _ in audit_rows()] + ["one two one", " lead", "trail ", "é", "A" * 300 + " " + "A" * 300]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    got = filter_audit.profile_texts(np.frombuffer(b"".join(raw), np.uint8), offsets, limit).T.tolist()
    assert got == [[len(w := WORD.findall(t)), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))] for t in texts]


def test_word_table_compares_bytes(monkeypatch):
    """With two hash values for all words the table still counts words, not hashes."""
    plain = filter_audit.hash_words
    monkeypatch.setattr(filter_audit, "hash_words", lambda *a: plain(*a) % np.uint64(2))
    text = " ".join(f"w{i % 40}" for i in range(200)).encode()
    assert filter_audit.profile_texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[1].tolist() == [40]


# conversation repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
BEGUN = re.compile(r"s?(ua)*u?")


def brute_repair(rows):
    """All edits of a few rows ``role, text, kind`` (blank, duplicate, truncated, fine); the cheapest, least audit."""
    best = None

    def go(i, out, cost, audit, made):
        nonlocal best
        if best and cost > best[0] or not BEGUN.fullmatch(out):
            return
        if i == len(rows) and GRAMMAR.fullmatch(out) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, made)
        if len(out) > len(rows) + 3:
            return
        for role in ("user", "assistant"):
            go(i, out + role[0], cost + 3, audit + "I", [*made, (role, "")])
        if i < len(rows):
            role, text, kind = rows[i]
            go(i + 1, out, cost + 4, audit + "D", made)
            if kind not in ("blank", "duplicate"):
                more = 3 * (kind == "truncated")
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, out + role[0], cost + more, audit + "K", [*made, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, out + r[0], cost + 3 + more, audit + "R", [*made, (r, text)])

    go(0, "", 0, "", [])
    return best


def brute_conversations(rows):
    """The contract by plain loops: damage, faults, counts and the cheapest repair."""
    out, found = [], defaultdict(list)
    for conv, turn, role, text in rows:
        mine = found[conv]
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        mine += [(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(code, 1)
    for conv, mine in found.items():
        mine.sort()
        seen, kinds = set(), []
        for _, _, role, text in mine:
            last = WORD.findall(text)[-1][-1] if WORD.search(text) else None
            kinds.append("blank" if last is None else "duplicate" if (role, text) in seen else "fine" if last in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for has, t, _, _ in mine if has}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, made = brute_repair([(r, t, k) for (_, _, r, t), k in zip(mine, kinds, strict=True)])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=lambda r: (r[0] is None, r))


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "d", "a", 3) for r in rows], TURNS)


def conversation_rows():
    rng = np.random.default_rng(11)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", None, ""], ["Fine.", "Cut", "", None, " \n", "What?", "Same.", "No! \t"]
    rows = [(c, t, roles[rng.integers(8)], texts[rng.integers(8)]) for c in range(60) for t in range(rng.integers(1, 5))]
    rows += [(100, None, "user", "a."), (100, 3, "assistant", "b."), (101, None, "user", "a."), (101, None, "user", "a."), (None, 1, "user", "x."), (None, None, "assistant", None), (102, -5, "user", "x."), (102, 5, "assistant", "y.")]
    return rows + [(103, 1, "user", "tie b."), (103, 1, "user", "tie a."), (103, 1, "assistant", "tie.")]


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_conversation_repair(spark, block):
    docs = turns_of(spark, conversation_rows()).repartition(4)
    got = [tuple(r) for r in conversations.repair_conversations(conversations.damage(docs), block).select(*COLUMNS).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r)) == brute_conversations(conversation_rows())


def test_long_conversation_is_split_into_blocks(spark):
    """One conversation over many blocks and tasks costs and reads as in one block."""
    rng = np.random.default_rng(2)
    rows = [(1, t, ["user", "assistant", "user", "system"][rng.integers(4)], ["a.", "b", f"text {t}.", f"{t}", ""][rng.integers(5)]) for t in range(3000)]
    docs = turns_of(spark, rows + [(c, 0, "user", "x.") for c in range(2, 40)])
    few, many = (tuples(conversations.repair_conversations(docs, b), *COLUMNS) for b in (10_000, 37))
    assert few == many and len(few) == 39
    runs = tuple((int(s), int(n)) for s, n in zip(rng.integers(0, 9, 400), rng.integers(1, 9, 400), strict=True))
    one_by_one = tuple((s, 1) for s, n in runs for _ in range(n))
    assert conversations.solve(runs) == conversations.solve(one_by_one)


def test_repaired_turns_follow_the_grammar(spark):
    docs = turns_of(spark, conversation_rows())
    turns = conversations.repaired_turns(docs).orderBy("conv_id", "position").collect()
    by_conv = defaultdict(list)
    for r in turns:
        by_conv[r["conv_id"]].append(r)
    assert all(GRAMMAR.fullmatch("".join(r["role"][0] for r in rs)) for rs in by_conv.values())
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in conversations.repair_conversations(docs).collect()}
    for conv, rs in by_conv.items():
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in rs).encode()).hexdigest() == hashes[conv]


def test_conversations_without_rows(spark):
    empty = turns_of(spark, [])
    assert conversations.repair_conversations(empty).count() == 0 and conversations.repaired_turns(empty).count() == 0
    gone = turns_of(spark, [(5, 1, "user", "x.")]).withColumn("copies", F.lit(0))
    assert tuples(conversations.repair_conversations(gone), *COLUMNS) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_stages_leave_columns_of_any_name_alone(spark):
    """Names that the stages use inside stay the caller's."""
    from riskloom.llm import stages

    names = ["_raw", "_key", "_bits", "_tie", "_log_weight", "_id", "column0"]
    rows = [(i, " ".join(f"w{x}" for x in range(i % 7 * 9, i % 7 * 9 + 40)), *[f"{n}{i}" for n in names]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for stage in (stages.quality_classifier, stages.exact_dedup_stage, stages.near_dedup, stages.decontaminate):
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert got.columns == docs.columns and set(map(tuple, got.collect())) <= set(rows) and got.count() > 0


def test_sample_does_not_follow_the_order_of_rows(spark):
    one = [(5, "alpha", "s"), (5, "beta", "s"), (6, "gamma", "s")]
    take = lambda rows: tuples(token_store.sampled(docs_of(spark, rows).coalesce(1), 10, 1), "doc_id", "text")
    assert take(one) == take(one[::-1]) and len(take(one)) == 2


def test_exception_phrases_reach_any_neighbour():
    from riskloom.llm import toxicity

    m = toxicity.Matcher({"bad ": 2.0}, set())
    long = "x" * 90
    assert m.hits(f"{long} {' ' * 60}bad{' ' * 60}{long}")[0][2] == (f"{long} bad", f"bad {long}")
    assert m.hits("bad")[0][2] == ("", "")


# models by plain loops


def test_secret_spans_equal_plain_loops(spark):
    """Training, cut and added spans of the Markov models, string by string."""
    import math

    from riskloom.llm import secrets

    rng = np.random.default_rng(4)
    make = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), n))
    plain = ["loremIpsumDolorSitAmetConsectetur", "the_quick_brown_fox_jumps_over", "version2024update", "short1", "ordinary words only", "password = hunter22"]
    rows = [(i, f"{plain[i % 6]} sees {make(32) if i % 2 else make(19)} and token: {make(24)} end {plain[(i + 1) % 6]}", "s") for i in range(60)] + [(100, None, "s"), (101, "", "s"), (7, "again", "s")]
    patterns = [
        (re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(1)) >= 6, "assign"),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20, "access"), (re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24, "hex"),
    ]
    word = re.compile("[A-Za-z0-9+/_=-]+")
    base = lambda t: [(name, *m.span()) for p, ok, name in patterns for m in p.finditer(t) if ok(m)]
    # the sample takes one text of an id
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, t or "")
    assert texts[7] != "again"
    texts = dict(tuples(token_store.sampled(docs_of(spark, rows), 2_000, 71), "doc_id", "text"))
    label = {}
    for t in texts.values():
        t = t or ""
        covered = [False] * len(t)
        for _, i, j in base(t):
            covered[i:j] = [True] * (j - i)
            last = word.findall(t[i:j])[-1:]
            label.update((c, True) for c in last if len(c) >= 20)
        open_ = "".join(" " if c else x for c, x in zip(covered, t, strict=True))
        for c in word.findall(open_):
            if len(c) >= 4 and (len(c) < 20 or not any(x.isdigit() for x in c)):
                label.setdefault(c, False)
    pairs = {True: defaultdict(int), False: defaultdict(int)}
    ordinary = [s for s, y in label.items() if not y] + secrets.generated_identifiers()
    for y, found in ((True, [s for s, y in label.items() if y] + secrets.generated_strings()), (False, ordinary)):
        for s in found:
            for a, b in zip("^" + s, s, strict=False):
                pairs[y][a, b] += 1
    states = "^" + secrets.ALPHABET
    total = {y: {a: sum(pairs[y][a, b] + 0.2 for b in states) for a in states} for y in (True, False)}
    log = lambda y, a, b: math.log((pairs[y][a, b] + 0.2) / total[y][a])
    score = lambda s: sum(log(True, a, b) - log(False, a, b) for a, b in zip("^" + s, s, strict=False)) / len(s)
    steps, cut = sorted((math.floor(score(s) / 0.001) for s in ordinary), reverse=True), 0.25
    allowed = 0.001 * len(steps)
    for step in sorted(set(steps), reverse=True):
        if sum(x >= step for x in steps) > allowed:
            cut = max(cut, (step + 1) * 0.001)
            break
    got = defaultdict(list)
    for r in secrets.scan_secrets(docs_of(spark, rows)).collect():
        got[r["doc_id"]].append(r["spans"])
    names, added = ["assign", "access", "hex", "markov"], 0
    for i, t, _ in rows:
        t, spans = t or "", base(t or "")
        for m in word.finditer(t):
            free = all(m.end() <= a or b <= m.start() for _, a, b in base(t))
            kinds = any(c.isdigit() for c in m.group()) + any(c.islower() for c in m.group()) + any(c.isupper() for c in m.group())
            if len(m.group()) >= 20 and free and kinds >= 2 and score(m.group()) > cut:
                spans.append(("markov", *m.span()))
                added += 1
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], names.index(s[0])))) in got[i]
    assert 25 <= added <= 35


def test_lexicon_equals_plain_loops(spark):
    """Counts, test and weights of toxic terms, document by document."""
    import math

    from riskloom.llm import toxicity

    rng = np.random.default_rng(6)
    vocab = [f"wort{i}" for i in range(60)] + ["mild", "milde", "vilo", "vilox"]
    rows = [(" ".join(rng.choice(vocab[:62], 15)) + (" vilo" if i % 3 == 0 else "") + (" vilox" if i % 7 == 0 and i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(150)]
    counts = defaultdict(lambda: [0, 0])
    for t, y in rows:
        words_ = {w for w in re.findall(r"[^\W_]+", t)}
        for f in {w + " " for w in words_ if len(w) > 2} | {w[:n] for n in toxicity.PREFIXES for w in words_ if len(w) > n}:
            counts[f][1 - y] += 1
    toxic, clean = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    base, bound = toxic / len(rows), 2 * math.log(len(counts) / toxicity.FALSE_RATE)
    part = lambda x, n, p: x * math.log(x / (n * p)) if x else 0.0
    strong = {f: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for f, (t, c) in counts.items() if t >= c and 2 * (part(t, t + c, base) + part(c, t + c, 1 - base)) >= bound}
    want = {}
    for f in sorted(strong, key=len):
        shorter = [want[f[:i]] for i in range(1, len(f)) if f[:i] in want]
        if not shorter or strong[f] > max(shorter) + 1:
            want[f] = strong[f]
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int").repartition(4))
    assert got.keys() == want.keys() and got == pytest.approx(want) and any(f.startswith("vil") for f in got)
