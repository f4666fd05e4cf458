"""Phrase collocations, the filter audit and quality rules against brute force."""

import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from signalloom.llm import collocation, interaction, linerules
from signalloom.llm.collocation import CollocationConfig
from signalloom.llm.linerules import LineRules
from tests.llm.test_llm import EDGE, docs


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---------------------------------------------------------------- collocations


def plain_collocations(rows, least, longest, top):
    """Straight from the definition; ``rows`` are ``(lang, text)``."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    f = {p: n for p, n in f.items() if n >= least}
    out = []
    for (lang, *p), a in f.items():
        p = tuple(p)
        if len(p) < 2:
            continue
        inside = lambda q: any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))  # noqa: E731, B023
        if any(g[0] == lang and len(g) - 1 > len(p) and inside(g[1:]) and 100 * n >= 100 * a for g, n in f.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[(lang, *p[:k])] * f[(lang, *p[k:])]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[(lang, *p[:k])], f[(lang, *p[k:])], total[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    return [(lang, rank, *r[1:]) for lang, g in itertools.groupby(out, key=lambda r: r[0]) for rank, r in enumerate(itertools.islice(g, top), 1)]


def mined(spark, rows, config):
    df = spark.createDataFrame([(lang, t, 1, "x", 2) for lang, t in rows], "lang string, text string, n long, p string, hash long")
    return [tuple(r) for r in collocation.collocations(df.repartition(3), config=config).orderBy("lang", "rank").collect()]


def chatter(seed, n=400):
    rng = random.Random(seed)
    common = ["a b c d e f", "New York City", "über ß ü", "x y", "the the the the"]
    rows = []
    for _ in range(n):
        words = [rng.choice(common) if rng.random() < 0.4 else f"w{int(rng.expovariate(0.2))}" for _ in range(rng.randrange(12))]
        rows.append((rng.choice(["en", "en", "en", "de", None, ""]), rng.choice([" ", "  ", "\t", ", ", "\n", " . "]).join(words)))
    return rows + [("en", None), (None, ""), ("en", " . \n"), ("fr", "alone")]


@pytest.mark.parametrize(
    "config",
    [
        CollocationConfig(least=5),
        CollocationConfig(least=5, most=40, bucket=64),  # prefixes of every length are hot
        CollocationConfig(least=5, book=6, most=30, bucket=200),  # most words are beyond the book
        CollocationConfig(least=2, top=7, longest=3, bucket=50),
        CollocationConfig(least=1, book=1, most=1, bucket=16),
    ],
    ids=["plain", "hot", "rare", "short", "one"],
)
def test_phrases_equal_brute_force(spark, config):
    rows = chatter(config.least, 120 if config.least < 3 else 400)
    assert mined(spark, rows, config) == plain_collocations(rows, config.least, config.longest, config.top)


def test_phrases_of_copies_and_ties(spark):
    """A passage that is copied often is one long candidate; equal scores stand in byte order."""
    rows = [("en", "One two three four five six")] * 300 + [("en", f"{a} {b}") for a, b in (("z", "é"), ("b", "a"), ("a", "b"))] * 100
    config = CollocationConfig(most=50)
    got = mined(spark, rows, config)
    assert got == plain_collocations(rows, 100, 5, 2000)
    assert [r[2] for r in got] == ["z é", "one two three four five", "two three four five six", "a b", "b a"]


def test_phrases_of_a_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(collocation, "SLICE", 1000)  # only this process; the functions that cut are called here
    rng = random.Random(4)
    import numpy as np

    codes = np.array([rng.randrange(4) for _ in range(5000)], np.uint32)
    got = np.concatenate(list(collocation.contexts(codes, 5)), axis=1)
    ahead = [*codes.tolist(), 0, 0, 0, 0, 0]
    want = []
    for i in range(len(codes)):
        c = list(itertools.takewhile(bool, ahead[i : i + 5]))
        if len(c) > 1:
            want.append(c + [0] * (5 - len(c)))
    assert got.T.tolist() == want
    text = " ".join(rng.choice("abcdefgh") for _ in range(300_000))
    assert mined(spark, [("en", text), ("en", "a b")], CollocationConfig(longest=3)) == plain_collocations([("en", text), ("en", "a b")], 100, 3, 2000)


def test_phrases_of_nothing(spark):
    assert mined(spark, [], CollocationConfig()) == [] and mined(spark, [(None, None)] * 3, CollocationConfig()) == []


# ---------------------------------------------------------------- the filter audit


def plain_audit(cells, letters):
    """``cells``: (part, failed letters, good, toxic) of single documents."""
    out = {}
    for part in {c[0] for c in cells}:
        own = [c for c in cells if c[0] == part]
        total = Counter()
        for order in itertools.permutations(letters):
            left = list(own)
            for step, x in enumerate(order, 1):
                here = [c for c in left if x in c[1]]
                left = [c for c in left if x not in c[1]]
                fails = sum(x in c[1] for c in own)
                total[x] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), fails - len(here), sum(c[1] == {x} for c in own), sum(c[2] for c in here), sum(c[3] for c in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_polynomial_values_are_shapley_values():
    rng = random.Random(1)
    for n in (1, 3, 5):
        counts = [rng.randrange(50) for _ in range(1 << n)]
        poly = interaction.removal_polynomial(counts)
        removed = [sum(c for m, c in enumerate(counts) if m & s) for s in range(1 << n)]
        assert interaction.corners(poly) == removed
        for k in range(n):
            assert interaction.shapley(poly, k) == sum((Fraction(c, m.bit_count()) for m, c in enumerate(counts) if m >> k & 1), Fraction(0))


def test_audit_equals_brute_force(spark):
    rng = random.Random(2)
    words = ["the", "of", "and", "A", "B#", "ÄÖ", "|"] + [f"w{k}" for k in range(90)]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 97])]) for _ in range(rng.randrange(100))) for _ in range(60)] + ["", None, " \n", "X" * 5000]
    rows = [(k, rng.choice(texts), rng.choice(["s", "t", None, ""])) for k in range(400)] + [(7, texts[0], "s"), (7, texts[0], "s"), (None, texts[0], "s"), (None, texts[1], "u")]
    given = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 400, 2)] + [(4, 1, 0), (None, 1, 1)]
    first, good, toxic = {}, Counter(), Counter()
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in given:
        good[i], toxic[i] = max(good[i], q or 0), max(toxic[i], x)
    cells = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))), ("E", i is not None and first[t] < i)]
        cells.append((s or "", {x for x, f in fails if f}, good[i] if i is not None else 0, toxic[i] if i is not None else 0))
    df = spark.createDataFrame([(*r, 0, "x", 1, True) for r in rows], "doc_id long, text string, source string, mask int, part string, n long, first boolean")
    labels = spark.createDataFrame([(*r, "x") for r in given], "doc_id long, quality int, toxic int, text string")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in interaction.audit_documents(df, labels).collect()}
    assert got == plain_audit(cells, "ABCDE")


def test_audit_of_nothing_and_of_too_many_filters(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit_documents(docs(spark, []), labels).count() == 0
    edge = interaction.audit_documents(docs(spark, EDGE), labels).collect()
    assert len(edge) == 600 and {r["kept"] for r in edge if r["step"] == 5} == {0}
    with pytest.raises(ValueError, match="filters"):
        interaction.audit(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "ABCDEFGH")


# ---------------------------------------------------------------- quality rules


def plain_rules(rows, rules):
    """``rows``: (id, text, host); one tuple of figures a row, and the text without frequent lines."""
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    norm = lambda line: tuple(cut(lower(line)))
    holders, hosts = {}, {}
    for _, t, host in rows:
        lines = tuple(x for x in (t or "").split("\n") if x)
        hosts.setdefault(host or "", set()).add(lines)
        for line in lines:
            if norm(line):
                holders.setdefault((host or "", norm(line)), set()).add(lines)
    frequent = {k for k, v in holders.items() if len(v) > rules.min_docs and len(v) > rules.share * len(hosts[k[0]])}
    out = []
    for i, t, host in rows:
        t = t or ""
        w = cut(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) for j in range(3) if grams[tuple(w[k : k + 3])] > 1}
        seen, dup, gone, removed, left = set(), 0, 0, 0, []
        for line in t.split("\n"):
            dup += bool(cut(line)) and line in seen
            seen.add(line)
            if (host or "", norm(line)) in frequent:
                gone, removed = gone + len(cut(line)), removed + 1
            else:
                left.append(line)
        failed = len(w) < rules.min_words or 100 * len(covered) > rules.repeat_percent * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed, not failed and gone <= rules.depleted * len(w), removed, "\n".join(left).strip("\n")))
    return out


COLUMNS = ["doc_id", *linerules.STATS, "base_failed", "kept", "n_removed_lines"]


def ruled_rows(seed):
    rng = random.Random(seed)
    pool = ["Share  this\tpage", "share this page", "All rights réservés | 2020", "# a <b> & c", "x", "", "  "] + [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    rows = []
    for k in range(250):
        text = "\n".join(rng.choice(pool[:7] if rng.random() < 0.3 else pool) for _ in range(rng.randrange(14)))
        rows.append((k, text, rng.choice(["h", "h", "h", "i", None, ""])))
    rows += [(300 + k, rows[5][1], "h") for k in range(40)]  # copies
    return rows + [(i, t, "h") for i, t in EDGE]


@pytest.mark.parametrize("heavy", [0, 3, 100_000])
def test_rules_equal_brute_force(spark, heavy):
    rows = ruled_rows(5)
    rules = LineRules(min_docs=8, share=0.05, min_words=12, heavy=heavy)
    df = spark.createDataFrame([(*r, 3, [1], 9) for r in rows], "doc_id long, text string, source string, row long, lines array<int>, docs int").repartition(3)
    want = plain_rules(rows, rules)
    got = linerules.judge(df, rules)
    assert sorted(map(repr, (tuple(r) for r in got.select(*COLUMNS).collect()))) == sorted(repr(w[:9]) for w in want)
    clean = linerules.clean(df, rules)
    assert clean.columns == df.columns
    assert sorted((repr(r["doc_id"]), r["text"].strip("\n")) for r in clean.collect()) == sorted((repr(w[0]), w[9]) for w in want if w[7])


def test_rules_at_hand_worked_limits(spark):
    """Lines at the limit stay, lines beyond it go; half of the words may go and no more."""
    own = lambda k, n: " ".join(f"u{k}x{j}" for j in range(n))
    shared = " ".join(f"s{j}" for j in range(30))
    rows = [(k, f"{shared}\n{own(k, 30 if k else 29)}", "h") for k in range(21)] + [(50 + k, f"{shared}\n{own(k, 40)}", "i") for k in range(20)]
    got = {r["doc_id"]: r for r in linerules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[k]["kept"] for k in range(21)] == [False] + [True] * 20 and {got[k]["n_removed_words"] for k in range(21)} == {30}
    assert {(got[50 + k]["n_removed_lines"], got[50 + k]["kept"]) for k in range(20)} == {(0, True)}
    assert [tuple(s) for s in got[3]["removed"]] == [(0, len(shared))]


def test_rules_of_nothing_and_of_a_long_text(spark):
    assert linerules.judge(docs(spark, [])).count() == linerules.clean(docs(spark, [])).count() == 0
    rng = random.Random(3)
    long = "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20_000))
    rows = [(1, long, "h"), (2, "short", "h"), (3, long + "\n" + long.split("\n")[0], "h")]
    got = linerules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == sorted(w[:9] for w in plain_rules(rows, LineRules()))


def test_lines_of_whole_texts_are_hashed_alike_in_any_block(spark):
    import pyarrow as pa

    column = pa.array(["A  b\nc", None, "", "c\n\nA b", "a\tB"])
    _, _, found = linerules.line_facts(column)
    by = dict(zip(zip(found["doc"].tolist(), found["start"].tolist()), found["line"].tolist()))
    assert by[0, 0] == by[3, 3] == by[4, 0] and by[0, 5] == by[3, 0] and len(set(by.values())) == 2
    alone = linerules.line_facts(pa.array(["x", "a b"]).slice(1))[2]["line"].tolist()
    assert alone == [by[0, 0]]
