"""The training-data operators: nulls, blanks, ties, repeated rows, long texts, empty tables, clashing names."""

import collections
import html
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestack.llm import cooccurrence, leakage, mixing, queries, reading, stable_sample, term_counts
from lodestack.llm.text import cased_words, own_text, plain, sentences

# ---- problem 1


def test_burst_trie_counts_like_a_dict():
    random.seed(3)
    words = ["".join(random.choices("ab", k=random.randint(0, 12))) for _ in range(30_000)] + ["x" * 500]
    trie, want = term_counts.BurstTrie(), collections.Counter()
    for w in words:
        trie.add(w, 2, 1)
        want[w] += 1
    got = {prefix + rest: c for prefix, part in trie.subtrees() for rest, c in part.items()}
    assert got == {w: [2 * n, n] for w, n in want.items()} and trie.terms == len(want)
    assert any(len(prefix) > 2 for prefix, _ in trie.subtrees())


def test_terms_with_long_common_prefixes_are_spread():
    """100,000 terms share 80 characters, some leave them early: no routed part holds more than twice the median."""
    trie, shared = term_counts.BurstTrie(), "a" * 80
    words = [shared + f"{i:05d}" for i in range(100_000)] + [shared[:k] for k in range(1, 80, 7)] + [shared[:k] + "b" * k for k in range(80)]
    for w in words:
        trie.add(w, 1, 1)
    parts = list(trie.subtrees())
    assert sorted(p + r for p, c in parts for r in c) == sorted(set(words)) and max(len(c) for _, c in parts) <= term_counts.FULL
    heavy = {"f": {shared[:k] for k in range(term_counts.DEEPEST + 1)}}
    batches = term_counts._route(heavy)([term_counts._batch([term_counts._rows("f", p, c) for p, c in parts])])
    load = collections.Counter()
    for x in (x for b in batches for x in b.to_pylist()):
        load[x["prefix"], x["part"]] += len(x["rest"])
    deep = sorted(n for (p, _), n in load.items() if p == shared[: term_counts.DEEPEST])
    assert sum(load.values()) == len(set(words)) and len(deep) == term_counts.HEAVY_PART and deep[-1] <= 2 * deep[len(deep) // 2]


def rows_of(spark, records):
    """records: (field, record number, terms)."""
    return spark.createDataFrame([(f, t, r, 0, "clash") for f, r, t in records], "field string, terms array<string>, rec_a bigint, rec_b bigint, term string")


def test_term_frequencies(spark, monkeypatch):
    monkeypatch.setattr(term_counts, "HEAVY_PART", 8)
    random.seed(4)
    records = [("f", i % 300, [f"t{random.randint(0, 900)}" for _ in range(5)] + ["every", "every"]) for i in range(900)]
    records += [("f", 1000 + i, ["T" * 20_000]) for i in range(3)] + [("f", 5000, []), ("g", 1, ["a", "b"]), ("g", 1, ["a"]), ("g", 2, ["a"])]
    got = {(r.field, r.term): (r.occurrences, r.records, r.mark) for r in term_counts.term_frequencies(rows_of(spark, records).repartition(5)).collect()}
    held, n, holders = collections.defaultdict(set), collections.Counter(), collections.defaultdict(set)
    for f, r, terms in records:
        for t in terms:
            held[f, t].add(r)
            n[f, t] += 1
            holders[f].add(r)
    mark = lambda k: "rare" if len(held[k]) < 3 else "common" if 2 * len(held[k]) > len(holders[k[0]]) else None
    assert got == {k: (n[k], len(held[k]), mark(k)) for k in held}
    assert term_counts.term_frequencies(rows_of(spark, [])).count() == 0


# ---- problem 5


def files(spark, rows):
    return spark.createDataFrame([((p, s),) for p, s in rows], "source struct<relative:string,size:bigint>")


def test_sample_is_stable_and_only_grows(spark):
    first = [(f"r/p/f{i}", (i % 50) << 16) for i in range(2000)] + [(None, 5), ("r/p/null", None)]
    later = [(f"./r//p/f{i}", (i % 50 + 3) << 16) for i in range(0, 2000, 3)] + [(f"r/q/g{i}", 70_000) for i in range(500)]
    sample = lambda w: {r.identifier for r in stable_sample.poisson_sample(w).collect()}
    old = stable_sample.running_weights(stable_sample.known_files(files(spark, first)))
    a, b = sample(old), sample(stable_sample.running_weights(stable_sample.known_files(files(spark, first[::-1] + first).repartition(7))))
    assert a == b and None not in a
    both = stable_sample.running_weights(stable_sample.known_files(files(spark, first), files(spark, later)))
    assert a < sample(both)
    assert sample(stable_sample.running_weights(stable_sample.known_files(files(spark, later)), old)) == sample(both)
    expected = sum(min(1.0, max(1, i % 50) * 0.02) for i in range(2000))
    assert abs(len(a) - expected) < 4 * expected**0.5
    assert sample(stable_sample.running_weights(stable_sample.known_files(files(spark, [])))) == set()


# ---- problem 7


def test_pair_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BLOCK_ENTRIES", 5000)
    monkeypatch.setattr(cooccurrence, "BLOCK_ITEMS", 900)
    random.seed(6)
    own = [sorted({f"é{random.randint(0, 40)}" if random.random() < 0.2 else f"i{int(random.paretovariate(0.7)) % 60}" for _ in range(random.randint(0, 9))}) for _ in range(800)]
    own += [[f"w{i}" for i in range(300)]]  # one very long basket
    df = spark.createDataFrame([(b, "x") for b in own], "items array<string>, item_a string").repartition(3)
    single, pair, n = collections.Counter(), collections.Counter(), sum(1 for b in own if b)
    for b in own:
        single.update(b)
        pair.update(itertools.combinations(sorted(b, key=str.encode), 2))
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in cooccurrence.pair_counts(df).collect()}
    assert got == {k: (v, single[k[0]], single[k[1]], n) for k, v in pair.items()}
    few = cooccurrence.pair_counts(df, 8)
    assert {(r.item_a, r.item_b): r.n_ab for r in few.collect()} == {k: v for k, v in pair.items() if v >= 8}
    strong = {(r.item_a, r.item_b) for r in cooccurrence.associated(few, 1).collect()}
    assert strong == {k for k, v in pair.items() if v >= 8 and n * v >= single[k[0]] * single[k[1]]}
    assert cooccurrence.pair_counts(df.limit(0)).count() == 0


def test_baskets_unite_copies(programs):
    df = programs([(1, "r/p/a", "A", None, ["x", "d/y", None], None), (2, "./r/p/a", "a", None, [" y", "z", ""], None), (3, "r/p/b", "1", None, None, None)])
    assert [sorted(r["items"]) for r in cooccurrence.baskets(df).collect()] == [["x", "y", "z"]]


# ---- problem 8


def test_words_of_posts():
    text = "[quote=ann]It&#39;s <b>really</b> *so*\n> [b]bold[/b]&nbsp;1 < 2 [deleted] <br\nend[/quote] a_b &lt;i&gt;"
    assert [w.lower() for w in cased_words(text)] == ["it", "s", "really", "so", "bold", "1", "2", "deleted", "end", "a", "b", "i"]


def brute_leaks(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", html.unescape(plain(t)).lower()) if t else []
    runs = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    theirs = {i: runs(words(t)) for i, t in items}
    return {(d, i) for d, t in docs for i in theirs if runs(words(t)) & theirs[i]}


ITEM = "The train left Ferrol at 9 and reached Vigo after 140 km, which took Clara two hours in the heavy rain."


def leak_tables(spark):
    passage = ITEM.split()
    docs = [
        (1, "I read: " + ITEM), (2, "> " + "\n> ".join(ITEM.upper().split())), (3, " ".join(passage[:11])), (4, "so " + " ".join(f"<b>{w}</b>" for w in passage[4:16]) + "!"), (5, None), (6, ""),
        (7, ITEM.replace("Ferrol", "Lugo").replace("140", "95").replace("9", "7")), (8, "x " * 200_000 + ITEM), (1, "again " + ITEM), (9, " ".join(reversed(passage))),
    ]
    items = [(10, "s", ITEM), (11, "s", ITEM), (12, "s", None), (13, "s", "too short"), (14, "s", "")]
    return spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id bigint, suite string, text string"), docs, [(i, t) for i, _, t in items]


def test_literal_leaks(spark):
    documents, items, docs, raw = leak_tables(spark)
    got = leakage.literal_leaks(documents, items)
    pairs = sorted(tuple(r) for r in got.collect())
    assert pairs == sorted(brute_leaks(docs, raw)) and (8, 10) in pairs and (3, 10) not in pairs and (7, 10) not in pairs
    assert {r.item_id: r.documents for r in leakage.leak_report(got, items).collect()} == {10: 4, 11: 4, 12: 0, 13: 0, 14: 0}
    assert leakage.literal_leaks(documents.limit(0), items).count() == 0 and leakage.literal_leaks(documents, items.limit(0)).count() == 0


def test_windows_are_shuffled_where_they_are_too_large_to_broadcast(spark):
    documents, items, docs, raw = leak_tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {tuple(r) for r in leakage.literal_leaks(documents, items).collect()} == brute_leaks(docs, raw)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_in_sentences_and_vocabulary(spark):
    assert leakage.words_in_sentences("Ann ran. Bob sat, Cid") == [("Ann", True), ("ran", False), ("Bob", True), ("sat", False), ("Cid", False)]
    items = spark.createDataFrame([("My friend saw Ann run 9 km and 10 km. My dog",), ("we saw my Will will",), (None,), ("",)], "text string")
    own = leakage._Templates(leakage.vocabulary(items))
    kinds = {w: next((k for k, c in own.fixed.items() if c == own.code(w)[0]), None) for w in "ann 9 km my will friend".split()}
    assert kinds == {"ann": "<name>", "9": "<number>", "km": "<unit>", "my": None, "will": None, "friend": None}
    assert leakage.vocabulary(items.limit(0)) == {}


def test_reparameterised_leaks(spark):
    documents, items, _, _ = leak_tables(spark)
    got = {(r.doc_id, r.item_id) for r in leakage.reparameterised_leaks(documents, items).collect()}
    assert (7, 10) in got and not {d for d, _ in got} & {3, 5, 6, 9}


def test_leaks_of_a_template_that_many_items_share(spark):
    """Variants of one question are all found, however many there are, a literal copy of one among them, too; a phrase shorter than a run is not."""
    filled = lambda *new: ITEM.replace("Ferrol", new[0]).replace("Clara", new[1]).replace("140", new[2])
    items = [(k, filled("Aba Dol Fen Gil Hup Jor Kal Lem Mur Nop".split()[k], "Ann", str(150 + k))) for k in range(10)]
    phrases = [(20 + k, f"The {w} story opens with these words: " + " ".join(ITEM.split()[:14]) + f", {w} ends.") for k, w in enumerate("long short old new sad odd".split())]
    docs = [(1, "I read: " + filled("Lugo", "Maria", "95")), (2, "Same here. " + items[3][1]), (3, " ".join(ITEM.split()[:14])), (4, filled("Lugo", "Lugo", "95")), (None, filled("Orense", "Eva", "7"))]
    posts, theirs = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items + phrases, "item_id bigint, text string")
    every = set(range(10))
    rows = leakage.reparameterised_leaks(posts, theirs).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, i) for d in (1, None) for i in every} | {(2, i) for i in every - {3}}
    assert {r.changed for r in rows if r.doc_id == 1} == {3} and len(rows) == 29


def test_planted_reparameterised_leaks(spark):
    """Items with their names and numbers replaced are found, stock phrases and ordinary posts are not."""
    items = spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet")
    rows, rng = items.collect(), random.Random(5)
    lower = {w for r in rows for w in re.findall(r"\b[a-z]+\b", r.text)}
    name = lambda: "".join(rng.choices("ba do ke mi ru sta lon gri ve pa zo tel".split(), k=3)).capitalize() + rng.choice("wxyz")

    def refilled(text):
        new = {}
        return re.sub(r"[A-Z][a-z]+|\d+", lambda m: m[0] if m[0].lower() in lower else new.setdefault(m[0], str(rng.randint(2, 999)) if m[0].isdecimal() else name()), text)

    docs, truth = [], set()
    while len(truth) < 80:
        r = rng.choice(rows)
        words = r.text.split()
        at, n = rng.randint(0, max(0, len(words) - 24)), rng.randint(28, 60)
        part = " ".join(words[at : at + n])
        if len(words[at : at + n]) >= 24 and refilled(part) != part:
            truth.add((10**9 + len(docs), r.item_id))
            docs.append((10**9 + len(docs), f"I found this one. {refilled(part)} What do you think?"))
    for k in range(80):
        docs.append((2 * 10**9 + k, f"Near {name()}, it was said so again. In {name()} it's said so: as {name()} told us, this spring, in {name()} it's said so."))
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    posts = real.unionByName(spark.createDataFrame(docs, "doc_id bigint, text string"))
    found = {(r.doc_id, r.item_id) for r in leakage.reparameterised_leaks(posts, items).collect()}
    literal = {tuple(r) for r in leakage.literal_leaks(posts, items).collect()}
    assert len(found & truth) >= 0.85 * len(truth)
    assert len(found & (truth | literal)) >= 0.9 * len(found) and not {d for d, _ in found if d >= 2 * 10**9}


# ---- problem 9


def test_rates_fill_up_to_the_total():
    targets = [("a", 50.0, 1), ("b", 30.0, 4), ("small", 10.0, 2), ("none", 10.0, 3)]
    have = {"a": 1000, "b": 200, "small": 10}
    got = mixing.rates(targets, have)
    assert got["none"] == 0 and got["small"] == 2 and got["b"] <= 4 and got["a"] <= 1
    assert sum(got[s] * have.get(s, 0) for s in got) == pytest.approx(min(1210, 1000 + 800 + 20))
    assert mixing.rates(targets, {"a": 100, "b": 100}, 80) == {"a": 0.5, "b": 0.3, "small": 0.0, "none": 0.0}
    assert mixing.rates([], {}) == {} and mixing.rates(targets, {}) == {s: 0.0 for s, _, _ in targets}


def test_mixture(spark):
    docs = [(i, "word " * (i % 7 + 1), ("Big Site", "big-site ", "BIG_SITE")[i % 3] if i % 10 else "small") for i in range(3000)] + [(9001, None, "small"), (9002, "", "small"), (9003, "x", None), (9004, "long " * 50_000, "small")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("rate", F.lit("clash"))
    targets = spark.createDataFrame([("big_site", 60.0, 1), ("Small", 30.0, 3), ("gone", 10.0, 2), ("gone", None, None), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    sizes = mixing.sized(df, targets)
    assert sizes.where("tokens >= 50000").count() == 1 and sizes.where("doc_id in (9001, 9002)").agg(F.sum("tokens")).first()[0] == 0
    planned = mixing.plan(sizes, targets)
    mixed = mixing.mixture(sizes, planned)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3 and mixed.where("source = 'big_site' and copy_no > 1").count() == 0
    again = mixing.mixture(mixing.sized(df.repartition(9), targets), planned)
    texts = mixing.mixed_documents(df, planned).join(df.select("doc_id", F.col("text").alias("own")), "doc_id")
    assert texts.count() == mixed.count() == texts.where("text <=> own").count()
    assert mixed.exceptAll(again).count() == 0 == again.exceptAll(mixed).count()
    out = {r.source: r for r in mixing.shares(mixed, planned).collect()}
    assert not out["gone"].met and out["gone"].tokens == 0 and sum(r.actual_share for r in out.values()) == pytest.approx(1)
    even = mixing.plan(sizes, targets.where("source <> 'gone'"), 3000)
    report = {r.source: r for r in mixing.shares(mixing.mixture(sizes.where("tokens < 100"), even), even).collect()}
    assert report["big_site"].met and report["big_site"].target_share == pytest.approx(2 / 3)
    assert mixing.mixture(mixing.sized(df.limit(0), targets), mixing.plan(mixing.sized(df.limit(0), targets), targets)).count() == 0


def test_token_counts_follow_the_tokenizer(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(mixing.default_tokenizer())
    own.encode_special_tokens = True
    texts = ["Hello  world", "naïve façade 🙂", "<|endoftext|>", "a" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.n for r in df.select("i", mixing.token_count(mixing.default_tokenizer())("text").alias("n")).collect()}
    assert got == {i: len(own.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


# ---- problem 10


@pytest.mark.parametrize("text, want", [
    ("[quote=a]x[quote]y[/quote]z[/quote]mine", "mine"), ("<blockquote><cite>b</cite>q<blockquote>r</blockquote></blockquote>mine", "mine"),
    ("bob wrote:\n> old\n>> older\nmine", "mine"), ("| boxed\n| text\n\nmine", "mine"), ("mine\n-- \nann\nslogan", "mine"), ("mine\n__________\nslogan", "mine"),
    ("mine\n[size=1]a | b[/size]", "mine"), ("mine\n<hr>~ ann ~", "mine"), ("mine\nslogan here | ann", "mine"), ("mine [code]\nstep 0 rc=2 buf=0x1\n[/code]", "mine"),
    ("<p>mine</p>", "mine"), ("[quote=a]never closed\n\nmine", "mine"), ("", ""), ("[quote]only[/quote]", ""), ("mine\r\n<pre>log</pre>", "mine"),
    ("mine\n-----\n" + "more " * 50 + "\n-- \nann", "mine" + " more" * 50), ("mine [code]\nlog 1\n\nmore", "mine more"), ("mine <pre>a\n\nb</pre> more", "mine more"),
])
def test_own_text(text, want):
    assert own_text(text, "ann").split() == want.split()


def test_sentences_join_wrapped_lines():
    assert sentences("One two\nthree. Four?\n\nfive") == ["One two three.", "Four?", "five"]


def test_reading_levels_on_held_out_posts(spark):
    random.seed(8)
    vocabulary = {1: "cat dog sun hat run big red mum bed egg", 2: "garden ladder butcher kettle rusty borrow village", 3: "committee temporary schedule delivery equipment administration", 4: "hermeneutic stochastic epistemological reification heteroscedastic"}
    text = lambda b: " ".join(" ".join(random.choices(vocabulary[b].split(), k=9)).capitalize() + "." for _ in range(6))
    docs = [(i, text(i % 4 + 1) + "\n[quote]" + text((i + 2) % 4 + 1) + "[/quote]", "ann") for i in range(120)]
    docs += [(500, None, None), (501, "", "ann"), (502, "Too short.", "ann"), (503, text(4) * 60, None)]
    labels = [(i, g, i % 4 + 1) for i in range(60) for g in ("g1", "g2")] + [(i, "g3", (i * 7) % 4 + 1) for i in range(60)] + [(0, "g1", 1), (1, "g1", None), (None, "g1", 2), (2, None, 3), (3, "g1", 9), (777, "g1", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, author string").withColumn("band", F.lit("clash"))
    graded = spark.createDataFrame(labels, "doc_id bigint, grader string, band int")
    model = reading.fit(df, graded, folds=2)
    levels = reading.difficulty(df, model)
    got = {r.doc_id: r.band for r in levels.collect()}
    assert set(got) == set(range(120)) | {503} and got[503] == 4
    assert sum(got[i] == i % 4 + 1 for i in range(60, 120)) >= 57
    assert sum(r.documents for r in reading.profile(levels).collect()) == 121
    assert reading.difficulty(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        reading.fit(df, graded.limit(0))
    without = reading.difficulty(df, reading.fit(df, graded.where("band <> 2 and doc_id % 4 <> 1 and grader <> 'g3'"), folds=2))
    assert sum(r.band == r.doc_id % 4 + 1 for r in without.where("doc_id between 60 and 119 and doc_id % 4 <> 1").collect()) >= 42
    weights = {(r.doc_id, r.band): r.part for r in reading.graded(graded).collect()}
    assert weights[5, 2] > 0.6 and (3, 9) not in weights


def test_profile_counts_every_document(spark, tmp_path):
    easy, hard = "The cat sat on the big red mat. ", "Heteroscedastic epistemological reification obtains. "
    docs = [(i, (easy if i % 2 else hard) * 10, "en", "ann") for i in range(20)]
    docs += [(30, easy * 10, "EN", None), (31, easy * 10, None, None), (32, easy, "en", None), (33, None, "en", None), (34, "[quote]only[/quote]", "de", None), (35, "", None, None)]
    docs += [(None, easy * 10, "en", None), (None, hard, "en", None)] + [(36, easy * 4, " En ", None)] * 2
    labels = [(i, g, 1 if i % 2 else 4) for i in range(20) for g in ("g1", "g2")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, author string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, grader string, band int").write.parquet(f"{tmp_path}/reading_labels.parquet")
    rows = queries.p10_profile(spark, str(tmp_path)).collect()
    got = {(r.lang, r.short, r.band): (r.documents, r.own_words) for r in rows}
    assert sum(r.documents for r in rows) == len(docs)
    assert got["en", False, 1] == (12, 12 * 80) and got["en", False, 4] == (10, 10 * 40)
    assert got["en", True, 1] == (3, 8 + 2 * 32) and got["en", True, 4] == (1, 4) and got[None, False, 1] == (1, 80)
    assert got["en", True, None] == got["de", True, None] == got[None, True, None] == (1, 0)
