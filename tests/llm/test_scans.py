"""License scan, languages, quality, personal data and benchmark passages against plain versions."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from compare import connect, differences
from conftest import rows
from plain import ODD, PATTERNS, plain_hits, plain_shape, plain_spans, plain_sure

from fieldtally.llm import decontaminate, language, licenses, personal, quality, registry

# Tables large enough to tell how well a classifier does on what it has not seen; beside the fixture's small ones.
HELD_OUT = "/root/testdata/sf0.01"

@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")

@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)

@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(name, spark, folder, con):
    assert differences(registry.queries()[name](spark, folder), con, registry.oracle_sql()[name]) == ""

# Benchmark passages

def test_automaton_against_plain_search(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(120)]
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))) for i in range(12)]
    automaton = decontaminate.Automaton(4)
    for item_id, item in items:
        automaton.add(str(item_id), [w for run in decontaminate.word_runs(item) for w in run])
    automaton.close()
    for text in texts:
        n, runs, found = automaton.read(text)
        hit = sum(b - a + 1 for a, b in zip(runs[::2], runs[1::2], strict=True))
        assert (n, hit, sorted(found)) == plain_hits(text, items, 4)
        assert all(a <= b for a, b in zip(runs, runs[1:], strict=False))

def test_words_are_the_same_either_way(spark, folder, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect()]
    texts += [None, "", "A-b_C9 \u00c9t\u00e9 \u00a0x\u2028y \U0001f600z {q}~\x7f", "n" * 5000 + " m"]
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 64)
    for text in texts:
        want = [m[0].encode() for m in decontaminate.words(text)]
        assert [w for run in decontaminate.word_runs(text) for w in run] == want


def test_items_in_several_automata(spark, odd):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice("abc") for _ in range(30))) for i in range(40)] + ODD
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(9)] + [(None, "a b"), (77, None), (3, "c c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (decontaminate.scan(docs, bench, window=5, block_words=b) for b in (10_000, 8))
    got = [sorted(tuple(map(str, r)) for r in x.select("doc_id", "n_words", "hit_runs", "hit_items").collect()) for x in (one, many)]
    assert got[0] == got[1]
    for row in many.select("text", "n_words", decontaminate.n_hit().alias("h"), "hit_items").collect():
        want = plain_hits(row.text, [x for x in items if len(row.text or "") < 1000], 5)
        if len(row.text or "") < 1000:
            assert (row.n_words, row.h, row.hit_items) == (want[0], want[1], [x for x in want[2] if x != "None"])

def test_few_items_make_few_automata(spark):
    """However many partitions a shuffle has, automata are as many as their words need."""
    items = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(300)], "item_id long, text string").repartition(50)
    assert decontaminate.automata(items).count() == 1
    words = [r.words for r in decontaminate.automata(items, block_words=90).collect()]
    assert sum(words) == 900 and max(words) <= 90 and len(words) <= 30

def test_decontamination_cuts_and_drops(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"Before, {item}! after", "a"), (2, "clean words", "b"), (3, "x " * 600 + f"W0 {item[3:]}. tail", "c"), (4, None, "d")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, hit_runs string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs.select("doc_id", "text"), bench)
    assert rows(kept, "doc_id", "text") == [(2, "clean words"), (3, "x " * 600 + ". tail"), (4, None)]
    empty = decontaminate.scan(docs.select("doc_id", "text").limit(0), bench)
    assert empty.count() == 0
    nothing = decontaminate.scan(docs.select("doc_id", "text"), bench.limit(0))
    assert all(not r.hit_runs for r in nothing.collect())

# Personal data

def test_seeds_against_plain_patterns(spark):
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.-+1 2()9%_é0/") for _ in range(rng.randint(0, 40)))
        assert personal.base_spans(text) == plain_spans(text)

def test_long_runs_cost_no_second_try():
    assert personal.base_spans("a" * 200_000 + " " + "1" * 200_000 + " " + "1." * 3 + "@" * 50_000) == []

def test_personal_query_against_plain(spark, folder):
    got = registry.queries()["op7_personal"](spark, folder).collect()
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(texts)
    for r in got:
        want = plain_spans(texts[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in want) for k in PATTERNS)
        assert set(listed) <= set(r.spans.split(",")) | {""}

def test_contexts_find_identifiers(spark):
    known = [(i, f"The account mail user{i}x@mail.example.com closed, host {10 + i}.1.2.3 seen") for i in range(30)]
    hidden = [(100 + i, f"note {i}. Their host {700 + i}.1.2.3 seen") for i in range(3)]
    clean = [(200 + i, f"In chapter {1000 + i} of {5000 + i * 7} pages order {123456 + i} stands") for i in range(30)]
    docs = spark.createDataFrame([*known, *hidden, *clean, *ODD], "doc_id long, text string")
    got = {r.doc_id: r for r in personal.with_spans(docs).collect() if r.doc_id and r.doc_id >= 10}
    for i, text in hidden:
        assert [text[s.start : s.end] for s in got[i].spans] == [f"{600 + i}.1.2.3"] and got[i].base == []
    assert all(got[i].spans == [] for i, _ in clean)
    masked = {r.doc_id: r.text for r in personal.mask(docs).collect() if r.doc_id and r.doc_id >= 10}
    assert masked[100] == "note 0. Their host <IP> seen" and masked[200] == clean[0][1]
    assert masked[15] == "The account mail <EMAIL> closed, host <IP> seen"

def found_texts(docs, texts):
    got = {r.doc_id: r.spans for r in personal.with_spans(docs).collect()}
    return {i: [t[s.start : s.end] for s in got[i]] for i, t in texts}

def test_unseen_strings_do_not_refuse_their_context(spark):
    known = [(i, f"host {10 + i}.1.2.3 seen") for i in range(30)]
    unseen = [(100 + i, f"host {700 + i}.1.2.3 seen") for i in range(15)]
    # Numbers that stand elsewhere more often speak against the one context they share with cards.
    cards = [(200 + i, f"item 411111111111{n} sold") for i, n in enumerate([c for c in range(1000, 9999) if personal.passes_luhn(f"411111111111{c}")][:20])]
    numbers = [n for n in range(5111111111111000, 5111111111111040) if not personal.passes_luhn(str(n))][:30]
    around = [("item", "sold"), ("order", "sent"), ("parcel", "lost"), ("bill", "paid")]
    orders = [(300 + 9 * i + j, f"{a} {n} {b}") for i, n in enumerate(numbers) for j, (a, b) in enumerate(around)]
    texts = [*known, *unseen, *cards, *orders]
    got = found_texts(spark.createDataFrame(texts, "doc_id long, text string"), texts)
    assert all(got[i] == [t.split()[1]] for i, t in known + unseen + cards)
    assert all(got[i] == [] for i, _ in orders)

def test_codes_in_the_place_of_addresses_stay(spark):
    """Known addresses in an order line make no address of 500 order codes, whatever shape those have."""
    texts = [(i, f"order 10.1.2.{i} shipped") for i in range(4)]
    texts += [(100 + i, f"order {'A' if i % 2 else 'B-'}{123400 + i}{'' if i % 2 else '-x'} shipped") for i in range(500)]
    # Numbers like addresses, but too many of them for the place to tell anything.
    texts += [(1000 + i, f"version 10.2.3.{i} out") for i in range(5)] + [(1100 + i, f"version 4.{300 + i}.1.7 out") for i in range(40)]
    # Two places that both know addresses, and a string that stands in both.
    texts += [(2000 + i, f"{a} 10.7.7.{i} {b}") for i in range(5) for a, b in (("from", "came"), ("to", "went"))]
    texts += [(2100 + i, f"{a} 900.{i}.7.7 {b}") for i in range(9) for a, b in (("from", "came"), ("to", "went"))]
    texts += [(2200 + i, f"from 901.{i}.7.7 came") for i in range(20)]
    got = found_texts(spark.createDataFrame([(n, t) for n, (_, t) in enumerate(texts)], "doc_id long, text string"), [(n, t) for n, (_, t) in enumerate(texts)])
    for n, (i, t) in enumerate(texts):
        assert got[n] == ([t.split()[1]] if i < 100 or 1000 <= i < 1100 or 2000 <= i < 2200 else []), t
    masked = personal.mask(spark.createDataFrame(texts[:504], "doc_id long, text string")).collect()
    assert sum("<IP>" in r.text for r in masked) == 4

def mixed(rng):
    """Random places: few words around, strings of all shapes, some of them known."""
    strings = [f"{rng.randrange(300)}.1.{rng.randrange(300)}.{rng.randrange(4)}" for _ in range(40)]
    strings += [f"{a}{rng.randrange(10**6)}" for a in ("", "A", "+49 ", "x-") for _ in range(12)]
    strings += [f"u{rng.randrange(99)}@{h}" for h in ("localhost", "mail.org") for _ in range(12)] + [f"j{i}[at]x.org" for i in range(4)]
    kind = {x: (0 if "@mail" in x else 1 if "." in x and "[" not in x else rng.choice([2, 3])) if rng.random() < 0.6 else None for x in strings}
    words = {"@": ["mail", "to"], "9": ["host", "peer"], "#": ["call", "card"]}
    out = []
    for _ in range(rng.choice([150, 400])):
        x = rng.choice(strings)
        near = words.get(plain_shape(x)[0], ["order", "host"]) if rng.random() < 0.97 else ["the", ""]
        out.append((kind[x], x, rng.choice(near), rng.choice(["seen", "gone", near[0]])))
    return out

@pytest.mark.parametrize("seed", range(6))
def test_rounds_against_plain_rounds(spark, seed):
    places = mixed(random.Random(seed))
    got = personal.sure_strings(spark.createDataFrame(places, "kind int, string string, before string, after string"))
    assert {r.string: r.kind for r in got.collect()} == plain_sure(places)

def test_plain_rounds_find_something_on_the_random_corpora():
    assert sum(len(plain_sure(mixed(random.Random(seed)))) for seed in range(6)) >= 30

def test_shapes_are_the_same_either_way(spark):
    strings = {x for seed in range(6) for _, x, _, _ in mixed(random.Random(seed))} | {"B-5500-x", "(555) 123-4567", "1.2", "12.", "jane.doe[AT]example.org", "äö9", "9"}
    frame = spark.createDataFrame([(x,) for x in sorted(strings)], "string string")
    assert {r.string: r.s for r in frame.select("string", personal.shape().alias("s")).collect()} == {x: plain_shape(x) for x in strings}

def test_precision_and_recall_on_a_mixed_corpus(spark):
    """Addresses, cards and codes in their own and in shared places; a tenth of the addresses fit no base pattern."""
    rng, texts, hidden = random.Random(9), [], set()
    for i in range(900):
        odd = i % 10 == 0
        ip = f"{rng.randrange(300, 999) if odd else rng.randrange(1, 255)}.{i % 250}.{rng.randrange(250)}.7"
        hidden |= {ip} if odd else set()
        texts.append(f"{rng.choice(['host', 'server', 'peer'])} {ip} {rng.choice(['seen', 'down', 'replied'])}")
        texts.append(f"{rng.choice(['order', 'part', 'host'])} {rng.choice('ABCX')}{rng.randrange(10**5, 10**6)} {rng.choice(['sent', 'seen'])}")
        texts.append(f"in {rng.randrange(10**5, 10**6)} {rng.choice(['cases', 'years'])} build 7.{300 + i}.{rng.randrange(99)}.2 ran")
    docs = list(enumerate(texts))
    got = found_texts(spark.createDataFrame(docs, "doc_id long, text string"), docs)
    found = {x for xs in got.values() for x in xs}
    true = {t.split()[1] for t in texts if re.search(r"(host|server|peer) [0-9.]+ ", t)}
    assert hidden <= found and found == true

def test_chains_of_contexts_are_followed_to_the_end(spark):
    texts = [(i, f"a0 {10 + i}.1.2.3 z0") for i in range(6)]
    for link in range(5):
        for i in range(6):
            name = f"{700 + 10 * link + i}.1.2.3"
            texts += [(len(texts), f"a{link} {name} z{link}"), (len(texts) + 1, f"a{link + 1} {name} z{link + 1}")]
    got = found_texts(spark.createDataFrame(texts, "doc_id long, text string"), texts)
    assert all(got[i] == [t.split()[1]] for i, t in texts)

def test_groups_and_address_like_words_are_found(spark):
    cards = [c for c in range(1000, 9999) if personal.passes_luhn(f"411111111111{c}")][:6]
    texts = [(i, f"card {s} expires") for i, s in enumerate(f"4111 1111 1111 {c}" for c in cards)]
    texts += [(10 + i, f"call +49 30 123 45{i} now") for i in range(6)]
    texts += [(20 + i, f"mail user{'x' * i}@mail.example.com closed") for i in range(6)]
    unseen = {"card": ["4111 1111 1111 1112"], "call": ["(555) 123-4567", "030 123 456"], "mail": ["jane@localhost", "jane.doe[at]example.org"]}
    ends = {"card": "expires", "call": "now", "mail": "closed"}
    texts += [(30 + i, f"{w} {s} {ends[w]}") for i, (w, s) in enumerate((w, s) for w in unseen for s in unseen[w])]
    texts += [(40, "pages 12 34 56 78 of 90a stay, user@ and @user too")]
    got = found_texts(spark.createDataFrame(texts, "doc_id long, text string"), texts)
    assert all(got[i] == ([] if i == 40 else [t.split(" ", 1)[1].rsplit(" ", 1)[0]]) for i, t in texts)

def test_long_runs_of_groups_cost_no_second_try():
    for text in ("1 " * 100_000 + "1x", "a" * 200_000 + "@", "(" * 100_000 + "1 1", "@" * 100_000, "1-" * 100_000 + " 1" * 100_000):
        assert len(list(personal.places(text, []))) <= 2

def test_personal_odd_rows(spark, odd):
    got = personal.with_spans(odd, keep=["doc_id"])
    assert got.count() == len(ODD) and all(r.spans == [] for r in got.collect())
    assert sorted(map(str, personal.mask(odd).collect())) == sorted(map(str, odd.collect()))
    assert personal.with_spans(odd.limit(0)).count() == 0 and personal.mask(odd.limit(0)).count() == 0

# Licenses

def test_license_notices_are_found_and_others_not(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    lines = {n: t for n, t in licenses.TEMPLATES.items() if "\n" not in t and "<" not in t}
    extra = [(-1, "words\n" + t.upper() + "\nmore words") for t in lines.values()]
    extra += [(-2, "intro\n" + licenses.TEMPLATES["MIT-notice"].replace("Software is furnished", "Software was furnished") + "\nThe end")]
    extra += [(-3, "We warrant nothing about the license plates of this car, copyright or not."), *ODD]
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    for r in licenses.scan(docs).collect():
        found = sorted((x.license, x.start) for x in r.licenses)
        if r.doc_id == -2:
            assert [x.license for x in r.licenses] == ["MIT-notice"] and r.licenses[0].different > 0
        elif r.doc_id == -3:
            assert r.n_blocks == 1 and not found
        else:
            plain = [(n, m.start()) for n, t in lines.items() for m in re.finditer(re.escape(t), r.text or "", re.IGNORECASE)]
            assert found == sorted(plain)
    assert licenses.scan(docs.limit(0)).count() == 0

# Where the usual layout of a notice has an empty line before.
PARAGRAPHS = {
    "Apache-2.0-notice": ["You may obtain", "http:", "Unless required", "See the License"],
    "BSD-2-Clause": ["Redistributions of source", "Redistributions in binary"],
    "GPL-3.0-notice": ["This program is distributed", "See the GNU"],
    "MIT-notice": ["The above copyright"],
}

@pytest.mark.parametrize("mark", ["", "#", " *", "//", "--"])
@pytest.mark.parametrize("name", sorted(PARAGRAPHS))
def test_notices_of_several_paragraphs(name, mark):
    ready, text = licenses.Templates(), licenses.TEMPLATES[name]
    for start in PARAGRAPHS[name]:
        text = text.replace(start, "\n\n" + start, 1)
    notice = "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))
    for body in (notice, f"import os\n\n{notice}\n\nAll rights reserved.\n\n{notice}\n\ndef main(): pass"):
        n, found = ready.found(body)
        assert n == 1 and [f[0] for f in found] == ([name] if body is notice else [name, "reserved", name])
        assert all(f[3] == 0 for f in found)

def test_paragraphs_hide_no_notice():
    ready = licenses.Templates()
    short = [t for n, t in licenses.TEMPLATES.items() if "\n" not in t]
    names = [n for n, t in licenses.TEMPLATES.items() if "\n" not in t]
    assert [f[0] for f in ready.found("\n\n".join(short * 40))[1]] == names * 40
    cut = licenses.TEMPLATES["MIT-notice"][:330]
    changed = licenses.TEMPLATES["MIT-notice"].replace("without restriction", "with no restriction").replace("to whom", "whom")
    assert [f[0] for f in ready.found(f"{cut}\n\n{changed}")[1]] == ["MIT-notice"]

def test_no_template_is_mistaken_for_another(spark):
    ready = licenses.Templates()
    for name, text in licenses.TEMPLATES.items():
        body = text.replace("<holder>", "the Example Project")
        assert [f[0] for f in ready.found(f"some words\n{body}\nother words")[1]] == [name]
        # Another version of the same wording is no license we know.
        for m in re.finditer(r"\b[0-9]+(\.[0-9]+)?\b", body):
            other = body[: m.start()] + "7.5" + body[m.end() :]
            assert name not in [f[0] for f in ready.found(other)[1]], other

@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("This work is licensed under the GNU General Public License, version 1.", []),
        (licenses.TEMPLATES["GPL-3.0-notice"].replace("GNU General", "GNU Lesser General"), []),
        (licenses.TEMPLATES["GPL-3.0-notice"].replace("GNU General", "GNU Affero General"), ["AGPL-3.0-notice"]),
        (licenses.TEMPLATES["Apache-2.0-notice"].replace("2.0", "1.1"), []),
        (licenses.TEMPLATES["MPL-2.0"].replace("v. 2.0", "v. 1.1"), []),
        (licenses.TEMPLATES["CC-BY-SA-4.0"].replace("4.0", "3.0"), []),
        (licenses.TEMPLATES["CC-BY-SA-4.0"].replace("Attribution", "Attribution-NonCommercial"), ["CC-BY-NC-SA-4.0"]),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", ["SPDX:GPL-2.0-or-later"]),
        ("// SPDX-License-Identifier: GPL-4.0-or-later", []),
        ("// SPDX-License-Identifier: MIT-0", []),
        ("// SPDX-License-Identifier: Apache-2.0 OR MIT", ["SPDX:Apache-2.0"]),
        # Clauses may be numbered, and a word that tells nothing may differ.
        ("1. " + licenses.TEMPLATES["BSD-2-Clause"].replace("Redistributions", "\n2. Redistributions"), ["BSD-2-Clause"]),
        (licenses.TEMPLATES["GPL-2.0-notice"].replace("hope that", "hope"), ["GPL-2.0-notice"]),
    ],
)
def test_words_that_tell_may_not_differ(text, names):
    assert [f[0] for f in licenses.Templates().found(f"x\n{text}\ny")[1]] == names

def test_a_notice_without_a_stem_makes_a_block(spark):
    given = {"plain": "Do what you like with this code as long as you remember us.", "usual": "Released under the Example License."}
    long = "some words " * 60_000
    docs = spark.createDataFrame([(1, "a\n" + given["plain"] + "\nb"), (2, long + "\n" + given["usual"] + "\n" + long), (3, "you like code")], "n_blocks long, text string")
    got = {r.text: [x.license for x in r.licenses] for r in licenses.scan(docs, templates=given).collect()}
    assert sorted(got.values()) == [[], ["plain"], ["usual"]]
    assert licenses.scan(docs, templates=given).columns == ["text", "n_blocks", "licenses"]
    assert licenses.Templates({}).found("a license")[1] == []

def test_templates_behind_the_best_few_are_confirmed(monkeypatch):
    ready, text = licenses.Templates(), "Licensed under CC BY 4.0."
    first = [(n, 1.0) for n in sorted(licenses.TEMPLATES) if n not in ("CC-BY-4.0", "CC-BY-NC-4.0")][:licenses.RANKED]
    monkeypatch.setattr(ready, "ranked", lambda words: [*first, ("CC-BY-4.0", 0.4)] if len(words) > 4 else [])
    assert [f[0] for f in ready.found(text)[1]] == ["CC-BY-4.0"]

# Languages

def test_languages_held_out(spark, folder):
    got = registry.queries()["op2_language"](spark, HELD_OUT)
    truth = spark.read.parquet(f"{HELD_OUT}/documents.parquet").selectExpr("doc_id AS d", "lang")
    right = got.join(truth, got.doc_id == truth.d).where("held_out").selectExpr("avg(IF(lang_pred = lang, 1, 0)) AS x", "count(*) AS n").first()
    assert right.n > 200 and right.x >= 0.99
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0

def test_languages_odd_rows(spark, odd):
    known = [(i, "the cat and the dog", "en") for i in range(5)] + [(9 + i, "der Hund und die Katze", "de") for i in range(5)]
    docs = spark.createDataFrame([*known, (50, None, "en"), (51, "text", None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.languages == ["de", "en"]
    got = rows(language.predict(odd, model), "doc_id", "lang_pred")
    assert [x for x in got if x[0] in (1, 2, 3, 6)] == [(i, "und") for i in (1, 2, 3, 6)]
    assert language.predict(docs.drop("lang").withColumnRenamed("doc_id", "score"), model).columns == ["text", "lang_pred", "score", "ambiguous"]
    none = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"}
    one = language.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language.predict(odd, one).collect()} == {"und", "en"}

def test_codewords_stand_apart():
    for n in (2, 4, 7, 12):
        code = language.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= code.shape[1] // 4 + 1 and all(abs(c.sum()) < n for c in code.T)

# Quality

def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())

def test_quality_held_out(spark):
    folder = HELD_OUT
    got = registry.queries()["op4_quality"](spark, folder)
    truth = spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id AS d", "quality")
    held = got.join(truth, got.doc_id == truth.d).where("held_out").toPandas()
    assert len(held) > 60 and auc(held.score.to_numpy(), held.quality.to_numpy()) >= 0.97
    assert ((held.score >= quality.THRESHOLD).astype(int) == held.predicted).all()
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0

def test_quality_rules_are_columns(spark, odd):
    rule = (("digits", False, 0.5), ("log_words", True, 1.0))
    scored = quality.with_statistics(odd).select("doc_id", "text", quality.compiled(rule).alias("met"))
    for r in scored.collect():
        s = dict(zip(quality.STATISTICS, quality.statistics(r.text), strict=True))
        assert r.met == (s["digits"] <= 0.5 and s["log_words"] > 1.0)

def test_quality_odd_rows(spark, odd):
    blank = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.score(odd, quality.train(odd, blank)).collect()} == {0.5}
    same = spark.createDataFrame([(5, 1), (5, 1), (6, 1), (2, None), (None, 1)], "doc_id long, label int")
    model = quality.train(odd, same)
    assert not model.rules and all(r.score > 0.5 for r in quality.score(odd, model).collect())
    assert quality.score(odd.withColumnRenamed("doc_id", "score"), model).columns == ["text", "score"]
    assert quality.score(odd.limit(0), model).count() == 0
