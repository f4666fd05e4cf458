import math
import os
import random
import subprocess
import sys

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from signalloom.llm import bpe, components, decontaminate, embdedup, licenses, linededup, lmscore, minhash, oracles, pii, quality, queries, urlfilter
from signalloom.llm import text as text_words
from signalloom.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, digest string, component long"


def docs(spark, rows):
    """Documents with columns whose names clash with those used inside the operators."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], DOC)


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


EDGE = [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "One"), (905, "x" * 3000), (None, "a null id here with words"), (906, "same row"), (906, "same row")]


def reach(pairs, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components_on_paths_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(5, 5)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in components.components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    want = reach(edges, {n for e in edges for n in e})
    assert all(want[n] == c for n, c in got.items()) and {n for n, c in want.items() if c != n} <= set(got)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    rows, base = [], prose(rng, 80)
    for k in range(260):
        if k % 13 == 0:
            base = prose(rng, 80)
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(words).upper() if k % 5 == 0 else " ".join(words)))
    rows += EDGE
    config = minhash.MinHashConfig(words=4, tile=8)
    out = minhash.near_duplicates(docs(spark, rows), config=config).collect()
    assert len(out) == len(rows)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = reach(pairs, sets)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_with_repeated_ids_and_rows(spark):
    """An id that repeats with equal and with different texts is one node with all its texts' links."""
    rng = random.Random(12)
    base = [prose(rng, 60) for _ in range(6)]
    rows = [(1, " ".join(base[0]))] * 1000 + [(2, " ".join(base[0] + ["x"]))] * 50 + [(9, " ".join(prose(rng, 30))) for _ in range(1000)]
    rows += [(3, " ".join(base[1])), (3, " ".join(base[2])), (4, " ".join(base[2] + ["y"])), (5, " ".join(base[3])), (None, " ".join(base[3]))]
    out = minhash.near_duplicates(docs(spark, rows), config=minhash.MinHashConfig(words=4)).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in out}
    assert got == {1: (1, True), 2: (1, False), 9: (9, True), 3: (3, True), 4: (3, False), 5: (5, True), None: (None, True)}
    named = minhash.near_duplicates(docs(spark, rows[-5:]).withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))).collect()
    assert {(r["doc_id"], r["component_id"]) for r in named} == {("id3", "id3"), ("id4", "id3"), ("id5", "id5"), (None, None)}


def test_posterior_bound_keeps_true_pairs():
    c = minhash.MinHashConfig()
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (3000, c.hashes), dtype=np.uint8)
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    far = np.where(rng.random(a.shape) < 0.4, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    least = minhash.least_matches(c)
    assert len(minhash.survive(c, a, b, least)[0]) == 3000 and len(minhash.survive(c, a, far, least)[0]) == 0


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df, rel = queries.QUERIES[name](spark, SF), con.sql(oracles.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    key = lambda rows: sorted([tuple(map(plain, r)) for r in rows], key=repr)
    assert key(df.collect()) == key([[r[i] for i in order] for r in rel.fetchall()])


def test_urls_of_any_form(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.NET/x?y"), (4, "http://example.net/en/1"), (5, "http://www.casino-a.example.com/en/1"), (6, "http://b.example.com"), (3, "http://A.NET/x?y")]
    out = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.RULES, queries.labelled_urls()).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == 7 and got[1] == got[2] == ("", "", None, "allow") and got[3] == ("a.net", "/x", "net/", "block") and got[4][2:] == ("example.net/en/", "allow") and got[6] == ("b.example.com", "", None, "allow")


def test_bad_sections_stand_out_at_any_fan_out_and_depth(spark):
    many = [(f"big.org/{'s' + chr(97 + k % 26) + chr(97 + k // 26)}/p", 0) for k in range(60) for _ in range(20)] + [("big.org/hell/p", 1)] * 200
    deep = [(f"deep.org/a/b/c/{x}/q/{chr(97 + k % 26)}", int(x == "bad")) for x in ("bad", "good") for k in range(60)]
    rows = [(i, f"http://{u}", bad) for i, (u, bad) in enumerate(many + deep)]
    seen = spark.createDataFrame(rows, "page_id long, url string, bad int")
    label = F.when(F.col("path").rlike("/(hell|bad)/"), 1).otherwise(0)
    out = {r["page_id"]: r for r in urlfilter.judge_urls(seen, {}, label).collect()}
    assert len(out) == len(rows) and all((out[i]["verdict"] == "block") == bool(bad) for i, _, bad in rows)
    assert out[0]["template"] == "big.org/*/p/" and len({r["template"] for r in out.values()}) < 60


def test_pages_of_one_host_are_judged_by_their_sections(spark, tmp_path):
    """The query itself: thin pages make a section bad beside a good one of the same host, and held-out pages follow."""
    rng = random.Random(12)
    article = lambda n: f"<html><nav>menu of many words here</nav><article><h1>t</h1><p>{' '.join(prose(rng, n))}</p></article></html>"
    rows = []
    for k in range(400):
        section = ("guide", "tags", "blog")[k % 3]
        thin = rng.random() < {"guide": 0.03, "tags": 0.97, "blog": 0.1}[section]
        size = rng.randrange(60, 95) if k % 10 == 0 else rng.randrange(5, 40) if thin else rng.randrange(120, 300)  # every tenth is no example
        rows.append((k, f"https://mixed.example.org/{section}/{'abcdefgh'[k % 8]}{k}", article(size)))
    rows += [(500, "https://mixed.example.org/guide/x", None), (501, None, article(200)), (502, "https://lone.example.org/", ""), (503, "https://mixed.example.org/tags/zz", article(70))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    out = {r["page_id"]: r for r in queries.judged_urls(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows) and all(out[k]["verdict"] == ("block" if k % 3 == 1 else "allow") for k in range(400))
    assert (out[503]["verdict"], out[500]["verdict"], out[501]["verdict"]) == ("block", "allow", "allow")
    flat = urlfilter.judge_urls(spark.read.parquet(str(tmp_path / "pages.parquet")), queries.RULES, queries.labelled_urls(html=True), config=urlfilter.TemplateConfig(z=1e9))
    assert {r["verdict"] for r in flat.where("host = 'mixed.example.org'").collect()} == {"allow"}  # without branches the section is not seen
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rel = con.sql(oracles.ORACLE_SQL["op2_url_filters"])
    plain = lambda found: sorted(repr([round(v, 5) if isinstance(v, float) else v for v in r]) for r in found)
    assert plain(queries.judged_urls(spark, str(tmp_path)).select(*rel.columns).collect()) == plain(rel.fetchall())


def test_the_overall_share_blocks_no_host_without_labels(spark):
    rows = [(k, f"http://casino-{k % 9}.example.com/a") for k in range(90)] + [(100, "http://calm.example.com/a")]
    out = {r["page_id"]: r for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), {}, queries.labelled_urls()).collect()}
    assert out[100]["purity"] >= 0.5 and out[100]["verdict"] == "allow" and all(out[k]["verdict"] == "block" for k in range(90))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_is_the_smoothed_recursion(spark, order):
    rng = random.Random(order)
    rows = [(k, " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randrange(9)))) for k in range(40)] + EDGE
    config = lmscore.LmConfig(order=order, mass=3.0, block_tokens=64)
    out = lmscore.score_texts(docs(spark, rows), F.col("doc_id") % 3 != 0, config=config).collect()
    counts = {}
    token = lambda t: ["$", *(t or "").lower().split(), "$"]
    for i, t in rows:
        if i is None or i % 3:
            w = token(t)
            for n in range(1, order + 1):
                for k in range(max(1, n - 1), len(w)):
                    key = tuple(w[k - n + 1 : k + 1])
                    counts[key] = counts.get(key, 0) + 1
    size, kinds = sum(c for k, c in counts.items() if len(k) == 1), sum(len(k) == 1 for k in counts)

    def p(context, w):
        if not context:
            return (counts.get((w,), 0) + 1) / (size + kinds + 1)
        return (counts.get((*context, w), 0) + 3.0 * p(context[1:], w)) / (counts.get(context, 0) + 3.0)

    want = sorted(sum(math.log10(p(tuple(w[max(0, k - order + 1) : k]), w[k])) for k in range(1, len(w))) for w in (token(t) for _, t in rows))
    assert np.allclose(sorted(r["score"] for r in out), want) and {r["train_tokens"] for r in out} == {size}
    assert abs(sum(p((), w) for (w,) in [k for k in counts if len(k) == 1]) + 1 / (size + kinds + 1) - 1) < 1e-9


def test_repeated_passages_go_and_offsets_stay(spark):
    rng = random.Random(8)
    passage = ". ".join(" ".join(prose(rng, 9)) for _ in range(7)) + "."
    own = [". ".join(" ".join(prose(rng, 9)) for _ in range(4)) + "." for _ in range(4)]
    rows = [(0, own[0] + "\n" + passage), (1, own[1] + " " + passage + " " + own[2]), (2, own[3])] + EDGE
    out = {r["doc_id"]: r for r in linededup.dedup_units(docs(spark, rows)).collect()}
    assert out[0]["text"] == rows[0][1] and out[2]["text"] == own[3] and out[900]["text"] == ""
    (span,) = out[1]["removed"]
    assert rows[1][1][span["start"] : span["end"]].strip() == passage and out[1]["text"].replace(" ", "") == (own[1] + own[2]).replace(" ", "")


def test_short_later_occurrences_go_whatever_the_id_or_script(spark):
    rows = [(1, "first of all\nSubscribe now\nalpha 3.14"), (2, "Subscribe now\nbeta 2.14"), (None, "gamma\nSubscribe now"), (3, "今天天气很好。我们走吧。"), (4, "今天天气很好。他不去。"), (5, "twin line"), (5, "twin line"), (5, "own line"), (None, "twin line")]
    out = sorted((r["doc_id"] or 99, r["text"]) for r in linededup.dedup_units(docs(spark, rows), unit="sentence").collect())
    assert out == sorted([(1, rows[0][1]), (2, "beta 2.14"), (99, "gamma\n"), (3, rows[3][1]), (4, "他不去。"), (5, "twin line"), (5, ""), (5, "own line"), (99, "")])
    kept = {r["doc_id"]: r["text"] for r in linededup.dedup_units(docs(spark, rows[:5]), unit="sentence", min_words=5).collect()}
    assert kept[2] == rows[1][1] and kept[4] == "他不去。"


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_later_lines_equal_brute_force(spark, unit):
    """Every later line goes, whatever its length, and nothing else does while passages are off."""
    rng = random.Random(4)
    pool = [" ".join(prose(rng, rng.randrange(1, 12))) + rng.choice(["", ".", "!", ". Second part."]) for _ in range(60)]
    gap = "\n" if unit == "line" else "\n\n"
    rows = [(k, gap.join(rng.choice([p, p.upper(), p.replace(" ", "  ")]) for p in rng.choices(pool, k=rng.randrange(6)))) for k in range(80)]
    out = {r["doc_id"]: r for r in linededup.dedup_units(docs(spark, rows), unit=unit, passage_words=10**6).collect()}
    seen = set()
    for k, text in rows:
        kept = []
        for piece in text.split(gap):
            plain = " ".join(piece.lower().split()).rstrip(".!?")
            if plain not in seen:
                kept.append(piece)
            seen.add(plain)
        assert out[k]["text"].split() == gap.join(kept).split(), k
        left = "".join(text[a:b] for a, b in zip([0, *(s["end"] for s in out[k]["removed"])], [*(s["start"] for s in out[k]["removed"]), len(text)]))
        assert left == out[k]["text"] and out[k]["n_removed_words"] == len(text.split()) - len(left.split())


def test_sentences_go_only_in_long_passages(spark):
    rng = random.Random(5)
    said = ". ".join(" ".join(prose(rng, 8)).capitalize() for _ in range(6)) + "."
    own = [" ".join(prose(rng, 7)).capitalize() + "." for _ in range(6)]
    common = "All rights reserved."
    rows = [(1, f"{own[0]} {said} {common}"), (2, f"{own[1]} {said} {own[2]}\n{own[3]} {common} {own[4]}"), (3, f"{own[5]}\n{common}"), (4, common)]
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_units(docs(spark, rows)).collect()}
    assert out[1] == rows[0][1] and out[2] == f"{own[1]} {own[2]}\n{own[3]} {common} {own[4]}" and out[3].strip() == own[5] and out[4] == ""


def test_surrogates(spark):
    text = "Mr. John Smith wrote to ann.lee@corp.com and ANN.LEE@CORP.COM from 10.20.30.40. Call +1 (212) 555-0100 or 212-555-0100, card 4111 1111 1111 1111, ssn 123-45-6789. Mrs. Anna Smith; Frau Müller; Госпожа Иванова. token ghp_" + "a1B2" * 9
    rows = [(1, text), (2, "again ann.lee@corp.com"), (3, "nothing personal 2.0 here")] + EDGE
    out = pii.replace_entities(docs(spark, rows), "k")
    assert out.columns == [*docs(spark, rows).columns, "n_entities"] and out.count() == len(rows)
    got = {r["doc_id"]: r for r in out.collect()}
    new = got[1]["text"]
    for gone in ("John", "Smith", "ann.lee", "10.20.30.40", "555-0100", "4111", "123-45-6789", "Müller", "Иванова", "a1B2"):
        assert gone.lower() not in new.lower()
    mail = new.split(" wrote to ")[1].split(" ")[0]
    assert mail in got[2]["text"] and mail.upper() in new and got[3]["text"] == rows[2][1] and got[3]["n_entities"] == 0 and got[900]["text"] is None
    card = new.split("card ")[1][:19].replace(" ", "")
    assert sum((d if k % 2 else 2 * d - 9 * (d > 4)) for k, d in enumerate(map(int, card))) % 10 == 0 and new.startswith("Mr. ") and "Госпожа " in new
    surname = new.split(" wrote")[0].split()[-1]
    assert surname[0].isupper() and all("а" <= c.lower() <= "я" for c in new.split("Госпожа ")[1].split(".")[0])


def plain_surrogates(spark, rows):
    made = spark.createDataFrame([(k, e, False, False) for k, e in rows], "kind string, entity string, female boolean, male boolean")
    return pii.surrogates(Workspace(spark, "t"), made, "k")


def test_colliding_surrogates_are_drawn_again(spark):
    """Kinds with hardly any replacement of their own form get longer ones."""
    rows = [("email", f"{a}@x.yz") for a in "abcdefghij"] + [("ssn", f"{k:09d}") for k in range(50)] + [("phone", f"{k:02d}") for k in range(100)]
    out = plain_surrogates(spark, rows).collect()
    assert len({(r["kind"], r["surrogate"]) for r in out}) == len(rows) == len(out)
    for kind in ("email", "ssn", "phone"):
        assert not {r["surrogate"] for r in out if r["kind"] == kind} & {e for k, e in rows if k == kind}


def test_sixty_thousand_short_names_are_distinct(spark):
    names = [a + b + c for a in "bcdfghjklmnpqrstvwxyz" for b in "aeiouy" for c in (x + y for x in "bcdfghjklmnpqrstvwxyz" for y in "aeiouybcdfghjklmnpqrstvwx")]
    out = plain_surrogates(spark, [("name", n) for n in names[:60_000]])
    row = out.agg(F.count("*").alias("n"), F.countDistinct("surrogate").alias("d")).first()
    assert row["n"] == row["d"] == 60_000 and out.join(out.select(F.col("entity").alias("surrogate")), "surrogate", "left_semi").isEmpty()


def replaced(spark, *texts):
    out = {r["doc_id"]: r for r in pii.replace_entities(docs(spark, [*enumerate(texts)]), "k").collect()}
    return [out[k]["text"] for k in range(len(texts))], [out[k]["n_entities"] for k in range(len(texts))]


def test_names_are_followed_through_a_text(spark):
    (one, two, three, four), n = replaced(
        spark, "Mr. John Smith came. John Smith said hello. Smith left, SMITH's hat stayed. Smithson too.", "Mrs. Anna Smith and Dr. Jane Roe; Prof. J. R. Roe.", "John and Smith without a title.", "Dr. Roe"
    )
    first, last = one.split()[1], one.split()[2]
    assert one.split(" came. ")[1].startswith(f"{first} {last} said hello. {last} left, {last.upper()}'s hat") and "Smithson" in one and n[0] == 1 + 4
    assert "Smith" not in two and last in two and "Jane" not in two and two.count(four.split()[1]) == 2 and "J. R." in two and three == "John and Smith without a title."


def test_numbers_keep_their_form(spark):
    (text,), _ = replaced(spark, "212-555-0100 +1 212-555-0100 (212) 555-0100 212 555 0100 | IBAN DE89 3704 0044 0532 0130 00 | 3782 822463 10005 | 2001:db8:0:1:1:1:1:1 fe80::1:2 | sk-proj-a_b-c1234567890abcdefghij | at 12:30:45")
    phones, iban, amex, six, secret, rest = text.split(" | ")
    digits = lambda t: "".join(c for c in t if c.isdigit())
    assert digits(phones) == (d := digits(phones)[:10]) * 1 + "1" + d * 3 and d != "2125550100" and "+1 " in phones and "(" in phones
    assert iban.startswith("IBAN DE") and [len(p) for p in iban.split()[1:]] == [4, 4, 4, 4, 4, 2] and "3704" not in iban
    assert [len(p) for p in amex.split()] == [4, 6, 5] and "db8" not in six and six.count(":") == 10 and rest == "at 12:30:45"
    assert secret.startswith("sk-") and "1234567890" not in secret


def test_entities_of_any_length(spark):
    """Keys, hex secrets, addresses and names far longer than usual leave nothing in clear text."""
    rng = random.Random(6)
    made = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    key, secret, local, name = "sk-" + made("abcdefghij0123456789", 900), made("0123456789abcdef", 1500), made("abcdefgh", 300), "B" + made("aeiou", 200)
    (text,), _ = replaced(spark, f"{key} | {secret} | {local}@corp.com | Mr. {name} came | {name}")
    parts = text.split(" | ")
    assert [len(parts[0]), len(parts[1])] == [903, 1500] and parts[0].startswith("sk-") and name not in text and local not in text
    same = lambda a, b: sum(x == y for x, y in zip(a, b)) / len(a)
    assert same(parts[0][3:], key[3:]) < 0.3 and same(parts[1], secret) < 0.2
    assert max(parts[1].count(parts[1][k : k + 64]) for k in range(0, 1400, 64)) == 1  # the draws do not repeat


@pytest.mark.parametrize("text,gone,script", [
    ("السيد محمد هنا. ثم محمد ذهب", "محمد", "[\u0600-\u06ff]"), ("מר כהן כאן, כהן הלך", "כהן", "[\u0590-\u05ff]"), ("श्री राम यहाँ", "राम", "[\u0900-\u097f]"),
    ("我们见到王小明先生。王小明很好", "王小明", "[\u4e00-\u9fff]"), ("김철수 씨가 왔다. 김철수는", "김철수", "[\uac00-\ud7a3]"), ("Г-жа Анна Иванова и Иванова", "Иванов", "[а-я]"), ("Κύριος Νίκος", "Νίκος", "[α-ωςά]"),
])
def test_names_in_other_scripts(spark, text, gone, script):
    (new,), (n,) = replaced(spark, text)
    assert gone not in new and n >= 1 and len(__import__("re").findall(script, new.lower())) >= 3, new


def test_planted_entities_never_leak_and_stay_apart(spark):
    """Equal entities get equal surrogates, different ones different ones, over a whole corpus; text between stays."""
    rng = random.Random(11)
    mails, phones, people = [f"u{k}.x{k}@corp{k}.org" for k in range(40)], [f"({200 + k}) 555-01{k:02d}" for k in range(40)], [f"Mr. Ab{chr(97 + k % 26)}{chr(97 + k // 26)}o Cad{chr(97 + k % 26)}{chr(97 + k // 26)}e" for k in range(40)]
    rows, used = [], []
    for d in range(120):
        own = [rng.choice(pool) for pool in (mails, phones, people)]
        rows.append((d, f"start {own[0]} mid {own[1]} more {own[2]} end"))
        used.append(own)
    clash = docs(spark, rows).withColumns({"n_entities": F.lit("old"), "a": F.lit(1), "p": F.lit(2), "row": F.lit(3)})
    out = pii.replace_entities(clash, "k")
    assert out.columns == [c for c in clash.columns if c != "n_entities"] + ["n_entities"]
    new: dict[str, set] = {}
    for r in out.collect():
        assert r["n_entities"] == 3 and (r["a"], r["p"], r["row"]) == (1, 2, 3)
        parts = __import__("re").fullmatch(r"start (\S+) mid (\(\d{3}\) \d{3}-\d{4}) more (Mr\. \S+ \S+) end", r["text"]).groups()
        for old, fresh in zip(used[r["doc_id"]], parts):
            new.setdefault(old, set()).add(fresh)
    assert all(len(v) == 1 for v in new.values()) and len({next(iter(v)) for v in new.values()}) == len(new) and not set(new) & {next(iter(v)) for v in new.values()}


def test_classifier_holds_out(spark):
    scored = queries.quality_scores(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in scored) >= 0.95 * len(scored) and all(r["predicted"] for r in scored if r["quality"])


def test_classifier_without_labels_and_with_one_kind(spark):
    some = docs(spark, EDGE)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(some, none).collect()} == {0.5}
    assert len(quality.classify(some, spark.createDataFrame([(901, 1), (903, 1), (903, None)], "doc_id long, quality int")).collect()) == len(EDGE)


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng, pool = random.Random(2), "aAbB éÉßΣσς'sS't’ 12½ \n\t\x85　中文日本🙂İıK<|>endoftext!!é́"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(50))) for _ in range(500)] + ["<|endoftext|>a<|startoftext|>", "ab" * 400, "Hello  World"]
    rows = [*enumerate(texts), *EDGE]
    library = Tokenizer.from_file(path)
    out = bpe.encode(docs(spark, rows), path).collect()
    want = sorted((str(i), list(e := library.encode(t or "", add_special_tokens=False).ids), library.decode(e, skip_special_tokens=False)) for i, t in rows)
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in out) == want


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((12, 16))
    x = np.concatenate([centre[k % 12] + rng.standard_normal((1, 16)) * s for k in range(240) for s in (0.12,)])
    rows = [(k, [float(v) for v in x[k].astype(np.float32)], k % 2) for k in range(240)] + [(300 + k, rows0, 0) for k, rows0 in enumerate([[float(v) for v in x[0].astype(np.float32)]] * 3)]
    odd = [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [1.0, None] * 8, 0), (404, rows[0][1], None), (405, [1.0, 2.0], 0), (None, rows[0][1], 0), (406, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    out = {r["vec_id"]: r for r in embdedup.link_vectors(df, config=embdedup.EmbeddingConfig(window=4, block=32, tile=16)).collect()}
    m, l = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (l[:, None] == l[None, :])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    want = reach([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))], ids)
    assert all((out[i]["n_links"], out[i]["component_id"]) == (near[k].sum(), want[i]) for k, i in enumerate(ids))
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i and out[i]["kept"] for i in (400, 401, 402, 403, 404, 405, 406)) and out[None]["kept"]


def test_vectors_with_repeated_ids_equal_sql(spark, tmp_path):
    rng = np.random.default_rng(14)
    centre = rng.standard_normal((5, 8))
    made = lambda: (centre[rng.integers(5)] + 0.15 * rng.standard_normal(8)).astype(np.float32).tolist()
    rows = [(int(rng.integers(25)), made(), int(rng.integers(2))) for _ in range(80)] + [(5, [1.0] + [0.0] * 7, 0), (5, [1.0, 0.05] + [0.0] * 6, 0), (6, [1.0, 0.02] + [0.0] * 6, 0)]
    rows += [rows[0]] * 30 + [(5, None, 0), (None, rows[0][1], 0), (40, [1.0, 0.0], 0), (40, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "v"))
    out = embdedup.link_vectors(df, config=embdedup.EmbeddingConfig(window=8, block=32, tile=4))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/v/*.parquet'")
    rel = con.sql(oracles.OP8)
    key = lambda found: sorted(repr(r) for r in found if r[0] is not None)
    assert key(map(tuple, out.select(*rel.columns).collect())) == key(rel.fetchall())


def test_vectors_in_a_cone_are_met(spark):
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(math.sqrt(0.8) * unit(rng.standard_normal((1, 64))) + math.sqrt(0.2) * unit(rng.standard_normal((6000, 64))))
    step = rng.standard_normal((400, 64))
    step = unit(step - (step * x[:400]).sum(axis=1, keepdims=True) * x[:400])
    x = np.concatenate([x, 0.94 * x[:400] + math.sqrt(1 - 0.94**2) * step])
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    out = {r["vec_id"]: r["component_id"] for r in embdedup.link_vectors(df).collect()}
    pairs = np.argwhere(np.triu(x @ x.T >= 0.93, 1)).tolist()
    met = sum(out[a] == out[b] for a, b in pairs) / len(pairs)
    assert len(pairs) >= 400 and met >= 0.99, met


@pytest.mark.parametrize("inner", [0.8, 0.88, 0.91])
def test_vectors_in_several_tight_groups_equal_brute_force(spark, inner):
    """Eight groups in one label whose average pairs come close to the threshold."""
    rng = np.random.default_rng(int(100 * inner))
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    parts = []
    for _ in range(8):
        x = unit(math.sqrt(inner) * unit(rng.standard_normal((1, 64))) + math.sqrt(1 - inner) * unit(rng.standard_normal((700, 64))))
        step = rng.standard_normal((50, 64))
        step = unit(step - (step * x[:50]).sum(axis=1, keepdims=True) * x[:50])
        parts += [x, 0.94 * x[:50] + math.sqrt(1 - 0.94**2) * step]
    x = np.concatenate(parts)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    out = {r["vec_id"]: r for r in embdedup.link_vectors(df).collect()}
    near = unit(x) @ unit(x).T >= 0.93
    np.fill_diagonal(near, False)
    a, b = np.nonzero(np.triu(near))
    met = np.mean([out[p]["component_id"] == out[q]["component_id"] for p, q in zip(a.tolist(), b.tolist())])
    links = near.sum(axis=1)
    right = np.mean([out[k]["n_links"] == links[k] for k in np.flatnonzero(links).tolist()])
    assert len(a) >= 300 and met >= 0.99 and right >= 0.99, (len(a), met, right)


def test_license_places_and_expressions(spark):
    rows = [(1, "MIT License. the mit-license; Apache License, Version 2.0"), (2, "SPDX-License-Identifier: (MIT OR GPL-3.0) AND Apache-2.0 WITH LLVM-exception"), (3, "mit licenses"), (4, "SPDX-License-Identifier: MIT AND")] + EDGE
    out = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert (out[1]["n_base"], out[1]["first_word"], out[1]["last_word"], out[1]["base_labels"]) == (3, 0, 5, "apache,mit") and out[1]["labels"] == "apache,apache-2.0,mit"
    assert out[2]["permitted"] and out[2]["labels"] == "apache-2.0,gpl-3.0,mit" and out[3]["n_base"] == 0 and out[3]["first_word"] is None and out[4]["permitted"] is False
    assert licenses.postfix("a OR b AND c") == ["a", "b", "c", "and", "or"] and not licenses.evaluate(licenses.postfix("MIT OR"))[1] and out[900]["n_words"] == 0


def exhaustive(text, item):
    """Least edits between an item and any window of a text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        old, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return min(row)


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.1, 0.15, 0.2])
def test_leaks_equal_an_exhaustive_search(rate):
    """Recall against all windows at each rate of edits, and no false leak."""
    rng = random.Random(int(100 * rate))
    found = true = 0
    for size in (1, 4, 6, 12, 20, 33, 58, 80):
        items = [prose(rng, size) for _ in range(12)]
        texts = []
        for k in range(48):
            words, text = list(items[k % 12]), prose(rng, rng.randrange(90))
            for _ in range(round(rate * size)):
                p = rng.randrange(len(words))
                words[p : p + 1] = rng.choice([["new"], [], [words[p], "more"]]) if len(words) > 1 else ["new"]
            at = rng.randrange(len(text) + 1)
            texts.append(text[:at] + words + text[at:] if k % 4 else text)
        hashed = lambda rows: text_words.words_of(pa.array([" ".join(r) for r in rows]), decontaminate.APART)
        w, t = hashed(items), hashed(texts)
        got = {(d, i): n for d, i, n, *_ in decontaminate.Matcher(np.arange(12), w.hash, w.bounds, decontaminate.DecontaminationConfig()).search(t.hash, t.bounds)}
        want = {(d, i): n for d, x in enumerate(texts) for i, y in enumerate(items) if (n := exhaustive(x, y)) <= int(0.2 * size + 1e-9)}
        assert all(want.get(k) == n for k, n in got.items())
        found, true = found + len(got), true + len(want)
    assert true > 200 and found >= 0.95 * true, (found, true)


@pytest.mark.parametrize("place", ["start", "middle", "end", "spread"])
def test_leaks_of_any_length_wherever_the_edits_are(place):
    """Recall by length of the item, with all edits that are allowed in one place."""
    rng = random.Random(31)
    for size in (30, 40, 60, 80, 120, 200, 300, 1000):
        items, texts = [prose(rng, size) for _ in range(8)], []
        many = size // 5
        for k in range(40):
            words = list(items[k % 8])
            first = {"start": 0, "middle": (size - many) // 2, "end": size - many, "spread": 0}[place]
            for p in rng.sample(range(size), many) if place == "spread" else range(first, first + many):
                words[p] = f"new{rng.randrange(10**6)}"
            texts.append(prose(rng, rng.randrange(90)) + words + prose(rng, rng.randrange(90)))
        hashed = lambda rows: text_words.words_of(pa.array([" ".join(r) for r in rows]), decontaminate.APART)
        w, t = hashed(items), hashed(texts)
        got = {(d, i) for d, i, *_ in decontaminate.Matcher(np.arange(8), w.hash, w.bounds, decontaminate.DecontaminationConfig()).search(t.hash, t.bounds)}
        assert got <= {(k, k % 8) for k in range(40)} and len(got) >= 36, (size, len(got))


def test_blocks_without_candidates_hold_no_leak():
    """Single texts, each a block, whose candidates may all fall away before they are verified."""
    rng = random.Random(8)
    c = decontaminate.DecontaminationConfig()
    for size in (1, 8, 40, 120):
        item = prose(rng, size)
        w = text_words.words_of(pa.array([" ".join(item)]), decontaminate.APART)
        matcher = decontaminate.Matcher(np.arange(1), w.hash, w.bounds, c)
        none = np.zeros(0, np.int64)
        assert len(matcher.plausible(none, np.zeros(1, np.uint64), 10)) == 0 and len(matcher.agreed(none, 10)) == 0
        for k in range(25):
            words = [x if rng.random() < 0.3 else "other" for x in item]
            t = text_words.words_of(pa.array([" ".join(words)]), decontaminate.APART)
            assert all(n <= 0.2 * size for *_, n, _, _ in matcher.search(t.hash, t.bounds))
        t = text_words.words_of(pa.array(["", None]), decontaminate.APART)
        assert matcher.search(t.hash, t.bounds) == []


def test_items_without_id_and_ids_of_text(spark):
    rows = [("a", "one two three four five six"), ("b", "nothing"), (None, "seven eight nine ten")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id string, text string, edits int, item_id string")
    items = spark.createDataFrame([(None, "two three four five", 1), ("i", "eight nine ten", 2), ("j", None, 3)], "item_id string, text string, doc_id int")
    got = decontaminate.contaminated(df, items).collect()
    assert {(r["doc_id"], r["item_id"], r["first_word"], r["end_word"]) for r in got} == {("a", None, 1, 5), (None, "i", 1, 4)}


def test_leaks_are_found_in_slices_and_groups(spark):
    rng = random.Random(6)
    items = [(k, " ".join(prose(rng, 30))) for k in range(20)] + [(90, None), (91, "")]
    rows = [(d, " ".join(prose(rng, 40) + items[d % 20][1].upper().split() + prose(rng, 40))) for d in range(60)] + EDGE + [(None, items[3][1])]
    rows.append((70, " ".join(prose(rng, 300_000)) + " " + items[7][1]))
    config = decontaminate.DecontaminationConfig(group_bytes=2000)
    out = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), config=config).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in out} == {(d, d % 20, 0) for d in range(60)} | {(70, 7, 0), (None, 3, 0)}
    assert next(r for r in out if r["doc_id"] == 70)["first_word"] == 300_000


def test_workspace_without_a_checkpoint_folder(tmp_path):
    """A plain local session, in a process of its own, gets a temporary folder and no change of its settings."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "from signalloom.llm.workspace import Workspace\n"
        "a, b = Workspace(s, 'a'), Workspace(s, 'b')\n"
        "assert a.save(s.range(3)).count() == 3 and a.root.rsplit('/', 1)[0] == b.root.rsplit('/', 1)[0]\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_edit_distance_equals_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 7)), rng.integers(0, 4, rng.integers(0, 12))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
        assert decontaminate.edits(a, b)[0] == min(row)


def test_empty_tables(spark):
    empty, path = docs(spark, []), public_tokenizers.path("word_bpe_49k.json")
    none = spark.createDataFrame([], "item_id long, text string")
    assert minhash.near_duplicates(empty).count() == linededup.dedup_units(empty).count() == pii.replace_entities(empty, "k").count() == bpe.encode(empty, path).count() == 0
    assert licenses.scan_licenses(empty).count() == lmscore.score_texts(empty, F.lit(True)).count() == decontaminate.contaminated(empty, none).count() == 0
    assert embdedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string"), queries.RULES, queries.labelled_urls()).count() == 0


def test_pipeline_stages_decide(spark):
    sf = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.good_quality(spark, source, sf)
    assert good.columns == source.columns and good.count() < source.count()
    out = corpus_pipeline.run(spark, sf)
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    texts = {r["doc_id"]: r["text"] for r in source.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(i in texts[d] for d in kept for i in items) and len({texts[d] for d in kept}) == len(kept)
    bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    assert not kept & bad


def test_classifier_samples_the_smallest_hashes(spark):
    rows = [(k, "good words here" if k % 2 else "### !!! ###") for k in range(400)] + [(7, "a repeated id")] * 50
    found = quality.features(docs(spark, rows))
    labels = spark.createDataFrame([(k, k % 2) for k in range(500)], "doc_id long, quality int")
    config = quality.GamConfig(sample=40, rounds=3)
    cut = found.where(quality.sampled(found.select("doc_id"), labels, "quality", config))
    least = [r["doc_id"] for r in found.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(40).collect()]
    kept = {r["doc_id"] for r in cut.collect()}
    assert set(least) <= kept and len(kept) < 160
    assert quality.learn(cut, labels, config=config).base == quality.learn(found, labels, config=config).base


def test_pipeline_equals_brute_force(spark):
    """Stage by stage on whole tables: scores, all pairs of shingle sets, all windows of all items, the tokenizers library."""
    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    extra = source.orderBy("doc_id").limit(12)
    source = source.unionByName(extra).unionByName(extra.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(extra.withColumn("text", F.lit("another text of the same id, a clean one"))).coalesce(2)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = corpus_pipeline.good_quality(spark, source, sf)
    scores = {r["doc_id"]: r["score"] for r in quality.classify(source, labels).groupBy("doc_id").agg(F.max("score").alias("score")).collect()}
    kept = [(r["doc_id"], r["text"]) for r in good.collect()]
    once = source.groupBy("doc_id").count().where("count = 1 and doc_id is not null").collect()
    assert {i for i, _ in kept} & {r["doc_id"] for r in once} == {r["doc_id"] for r in once if scores[r["doc_id"]] >= 0.3}

    def shingles(t):
        w = (t or "").translate({k: k + 32 for k in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").split(" ")
        w = [y for x in w for y in x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if y]
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in kept]
    pairs = [(a, b) for a in range(len(kept)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = reach(pairs, range(len(kept)))
    one = corpus_pipeline.one_of_each(spark, good, sf)
    stayed = [(r["doc_id"], r["text"]) for r in one.collect()]
    first = {g: min((kept[k][0] if kept[k][0] is not None else 2**63 - 1) for k in group if group[k] == g) for g in set(group.values())}
    assert len(stayed) == len(first) and sorted((i if i is not None else 2**63 - 1) for i, _ in stayed) == sorted(first.values()) and one.columns == source.columns

    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hashed = lambda texts: text_words.words_of(pa.array(texts, pa.string()), decontaminate.APART)
    w, t = hashed(items), hashed([x for _, x in stayed])
    cut = lambda h: [h.hash[a:b] for a, b in zip(h.bounds[:-1], h.bounds[1:])]
    near = {k for k, x in enumerate(cut(t)) if any(len(y) and decontaminate.edits(y, x)[0] <= int(0.2 * len(y) + 1e-9) for y in cut(w))}
    clean = sorted(repr(x) for k, x in enumerate(stayed) if k not in near)
    left = corpus_pipeline.without_benchmark(spark, one, sf)
    assert sorted(repr((r["doc_id"], r["text"])) for r in left.collect()) == clean and near

    new = corpus_pipeline.without_personal_data(spark, left, sf)
    texts = [(r["doc_id"], r["text"], r["n_chars"]) for r in new.collect()]
    assert new.columns == source.columns and len(texts) == len(clean) and not any("@" in t and ".example" not in t for _, t, _ in texts)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = corpus_pipeline.tokens(spark, new, sf).collect()
    assert sorted(repr((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist())) for r in out) == sorted(repr((i, list(library.encode(t, add_special_tokens=False).ids))) for i, t, _ in texts)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.classify(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_trees_take_the_best_cuts():
    rng = np.random.default_rng(0)
    value = lambda g, h: g.sum() ** 2 / (h.sum() + 1)
    for _ in range(60):
        g, h = rng.standard_normal(9), rng.random(9) + 0.1
        one = quality._tree(g, h, 1)
        k = max(range(1, 9), key=lambda k: value(g[:k], h[:k]) + value(g[k:], h[k:]))
        want = np.concatenate([np.full(k, g[:k].sum() / (h[:k].sum() + 1)), np.full(9 - k, g[k:].sum() / (h[k:].sum() + 1))])
        best = value(g[:k], h[:k]) + value(g[k:], h[k:]) - value(g, h)
        assert np.allclose(one, want if best > 1e-9 else g.sum() / (h.sum() + 1))
        two, grid = rng.standard_normal((5, 6)), rng.random((5, 6)) + 0.1
        gain = quality._grid(two, grid)[0]
        side = lambda a, b: max([value(a, b), *(value(a[:, :j], b[:, :j]) + value(a[:, j:], b[:, j:]) for j in range(1, 6))])
        assert abs(gain - max(side(two[:k], grid[:k]) + side(two[k:], grid[k:]) for k in range(1, 5))) < 1e-9


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.FEATURES)))
    y = (x[:, 0] * x[:, 1] + 0.2 * rng.random(400) > 0.35).astype(float)
    model = quality.fit(x, y, quality.GamConfig(rounds=30))
    got = model.score(x)
    for r in range(0, 400, 37):
        total = model.base + sum(t[sum(e < x[r, k])] for k, (e, t) in enumerate(zip(model.edges, model.tables)))
        total += sum(t[sum(model.pair_edges[i] < x[r, i]), sum(model.pair_edges[j] < x[r, j])] for i, j, t in model.pairs)
        assert abs(got[r] - 1 / (1 + math.exp(-total))) < 1e-12
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.9


def test_license_places_equal_a_plain_search(spark):
    rng = random.Random(2)
    pool = "mit MIT license License licenses apache general public GNU v2 the ü-mit 2.0".split() + ["mit license", "apache license", "general public license"]
    rows = [(k, rng.choice([" ", "\n", "-", ", "]).join(rng.choice(pool) for _ in range(rng.randrange(25)))) for k in range(300)] + EDGE
    out = licenses.scan_licenses(docs(spark, rows)).collect()
    import re

    want = []
    for i, t in rows:
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode())
        hits = [(k, label) for phrase, label in licenses.BASE_PHRASES.items() for p in [phrase.encode().split()] for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        at = [k for k, _ in hits]
        want.append((str(i), len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in hits}))))
    assert sorted(map(repr, want)) == sorted(repr((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in out)


def test_one_very_long_text(spark):
    """Half a megabyte in one row among short ones, through every text operator."""
    rng = random.Random(9)
    lines = [" ".join(prose(rng, 40)) for _ in range(200)]
    long = "\n".join(rng.choice(lines) for _ in range(3_000)) + "\nwrite to long.text@corp.com"
    df = docs(spark, [(1, "short one"), (2, long), (3, long + " x"), (4, lines[3])]).coalesce(1)
    near = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert near == {1: 1, 2: 2, 3: 2, 4: 4}
    assert {r["doc_id"]: r["n_tokens"] for r in lmscore.score_texts(df, F.lit(True)).collect()}[2] == len(long.split()) + 1
    left = {r["doc_id"]: r["n"] for r in linededup.dedup_units(df).select("doc_id", F.length("text").alias("n")).collect()}
    assert left[2] < 100_000 and left[4] == 0
    assert len(quality.features(df).collect()) == 4 and {r["doc_id"]: r["n_words"] for r in licenses.scan_licenses(df).collect()}[2] == len(long.replace("@", " ").replace(".", " ").split())
    leak = decontaminate.contaminated(df, spark.createDataFrame([(7, lines[3])], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in leak} == {2, 3, 4} and {r["edits"] for r in leak} == {0}
    assert {r["doc_id"] for r in pii.replace_entities(df, "k").where("not contains(text, 'long.text') and n_entities = 1").collect()} == {2, 3}
