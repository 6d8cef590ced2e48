import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm import chat, contamination, fingerprints, html, lines, lm, mixing, near, toxicity, urls
from strandflow.llm.common import connected_components, load
from tests.compare import SF_DIR
from tests.llm.helpers import DOCS, clashing, odd_documents, prose


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


# ---- lines ------------------------------------------------------------------------------------------------------------


def lines_by_hand(rows, least):
    """rows: (doc_id, text) in order.  A line goes if an earlier one is the same or one edit away."""
    first, out = {}, []
    texts = sorted({(d, t or "") for d, t in rows})
    for d, t in texts:
        for p, raw in enumerate(t.split("\n")):
            line = raw.strip(lines.EDGE)
            if line:
                first.setdefault(line, (d, p))
    near_ = {b for b in first if len(b) >= least and any(len(a) >= least and a != b and first[a] < first[b] and one_edit(a, b) for a in first)}
    for d, t in texts:
        kept = [raw for p, raw in enumerate(t.split("\n")) if not raw.strip(lines.EDGE) or (first[raw.strip(lines.EDGE)] == (d, p) and raw.strip(lines.EDGE) not in near_)]
        out.append((d, "\n".join(kept)))
    return out


def test_lines_equal_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("ab ") for _ in range(r.randint(1, 12))) for _ in range(40)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaab", "baaaaaaa", "abaaaaaa"]
    rows = [(i, "\n".join(r.choice(base) + r.choice(["", "", " ", "a"]) for _ in range(r.randint(0, 6)))) for i in range(60)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_near=5)
    assert sorted((x["doc_id"], x["text"]) for x in got.collect()) == lines_by_hand(rows, 5)


def test_odd_lines(odd, none):
    got = lines.dedup_lines(clashing(odd)).select("doc_id", "text", "n_lines_", "n_dropped_", "source").collect()
    assert len(got) == odd.count()
    by = {x["doc_id"]: x for x in got}
    assert by[5]["text"] is None and by[6]["text"] == "" and by[2]["text"] == "" and by[2]["n_dropped_"] == 1 and by[1]["n_dropped_"] == 0
    assert by[11]["text"].startswith("Zeile\r\n\u00e9") and by[8]["n_dropped_"] == 0
    assert lines.dedup_lines(none).count() == 0


# ---- near copies ------------------------------------------------------------------------------------------------------


def edit_loop(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_is_exact():
    r = random.Random(1)
    for _ in range(1500):
        a = [r.randint(0, 3) for _ in range(r.randint(0, 14))]
        b = list(a) if r.random() < 0.7 else [r.randint(0, 3) for _ in range(r.randint(0, 14))]
        for _ in range(r.randint(0, 4)):
            if b and r.random() < 0.5:
                b.pop(r.randrange(len(b)))
            else:
                b.insert(r.randint(0, len(b)), r.randint(0, 3))
        most, d = r.randint(0, 8), edit_loop(a, b)
        assert near.edit_distance(np.array(a, int), np.array(b, int), most) == (d if d <= most else None)


def test_near_copies_are_found_and_others_left(spark):
    r = random.Random(2)
    rows, of = [], {}
    passage = prose(999, 60)
    for g in range(30):
        words = prose(g, 120).split()
        for c in range(4):
            mine = list(words)
            for _ in range(c * 2):
                mine[r.randrange(len(mine))] = "changed"
            rows.append((len(rows), " ".join(mine)))
            of[len(rows) - 1] = g
    for g in range(30, 90):
        rows.append((len(rows), prose(g, 70) + " " + passage))
        of[len(rows) - 1] = g
    got = {x["doc_id"]: x["class_id"] for x in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: min(x for x in of if of[x] == g) for d, g in of.items()}


def test_odd_near(spark, odd, none):
    got = near.near_classes(clashing(odd).select("doc_id", "text")).collect()
    assert len(got) == odd.count()
    by = {(x["doc_id"], x["k1"]): x for x in got}
    sizes = Counter(x["class_id"] for x in got)
    assert sizes[1] == 3 and sizes[4] == 3 and sizes[5] == 3 and by
    kept = near.drop_near_copies(clashing(odd))
    assert sorted(x["doc_id"] or -1 for x in kept.select("doc_id").collect()) == [-1, 1, 4, 5, 7, 8, 9, 9, 11]
    assert kept.columns == clashing(odd).columns
    assert near.near_classes(none).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


# ---- pages ------------------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><head><title>x</title></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two<br>three</p><p>Short.</p></article>"
     "<footer>&copy; us</footer></body></html>", "A & B\n\nOne two three\n\nShort."),
    ("<header><a href=/>Site</a></header><main><p>Text <b>bold</b> &lt;tag&gt; &#233;</p><form><input><p>Your mail address here</p></form>"
     "<div class='share-buttons'>Share</div></main><aside><p>Something else that is long enough to look like text of its own.</p></aside>", "Text bold <tag> \u00e9"),
    ("<body class='has-sidebar'><div class='content-with-sidebar'><article><p>Inside.</p><section id='comments'><p>I think so too and so do all of my friends.</p></section></article></div>"
     "<div class='cookie-notice'>We use cookies here.</div>", "Inside."),
    ("<script>var t='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><article><p>Yes</p><noscript><p>no</p></noscript>", "Yes"),
    ("", ""), ("<", ""), ("<article><p>a < b</p></article>", "a < b"), ("<article><p title='x>y'>ok</p>", "ok"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert html.main_text(page) == text


LONE = "The only paragraph of this article says a few things about its subject and then it goes on for a while."


@pytest.mark.parametrize("name", sorted(html.HINTS))
def test_names_alone_reject_no_article(name):
    """A container whose name hints at something else, around the only paragraph of an article."""
    for page in (f"<div id={name}-work><p>{LONE}</p></div>", f"<nav><a href=/>Home</a></nav><section class='{name}-archive'><p>{LONE}</p></section><footer>us</footer>"):
        assert html.main_text(page) == LONE


def test_markup_stays_out():
    """Scripts whose unquoted address ends in a slash, tags that the end of the page cuts off, elements closed as XML does it."""
    assert html.main_text(f"<article><p>{LONE}</p><script src=/js/app/>alert(1)</script></article>") == LONE
    assert html.main_text(f"<article><p>{LONE}</p><a href='x") == LONE
    assert html.main_text(f"<article><p>{LONE} <a") == LONE
    assert html.main_text(f"<nav class=/x/><p>{LONE}</p></nav><article><p>{LONE} Yes.</p></article>") == LONE + " Yes."
    assert html.main_text(f"<article><p>{LONE} 3 < 4") == LONE + " 3 < 4"


def test_held_out_pages():
    """The tree on pages that it wasn't trained on."""
    found = [b for page in html.labelled_pages(150, 77) for b in html.blocks(page)]
    assert sum(html.is_content(html.tree(), [b.feats[f] for f in html.FEATURES]) == b.text.startswith("+") for b in found) >= 0.98 * len(found)


def test_broken_pages_take_linear_time():
    import time

    began = time.time()
    for piece in ("<!--", "<a href='", "<div ", "<", "</p", "<p x=\"", "<script>", "<p x='>", "<b>", "<div>", "<article>", "<h1>", "</x>"):
        for end in ("", ">", "'>"):
            html.main_text(piece * 20000 + end)
    html.main_text("<div>" * 20000 + "</section>" * 20000)
    assert time.time() - began < 20


def test_pages(spark):
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] + [(None, None, None), (0, "u0", PAGES[0][0])]
    got = html.extract(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert [(x["page_id"], x["text"], x["n_chars"]) for x in got] == [(i, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(None, "", 0), (0, PAGES[0][1], len(PAGES[0][1]))]


# ---- chats ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("record,layout,turns", [
    ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"id":7}', "messages", [("user", "a"), ("assistant", "b")]),
    ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":null}]}', "from_value", [("user", "a"), ("assistant", "")]),
    ('{"data":{"messages":[{"role":"user","content":"a"}]}}', "nested_messages", [("user", "a")]),
    ('{"prompt":"a","response":"b"}', "prompt_response", [("user", "a"), ("assistant", "b")]),
    ('{"system":"s","prompt":"a","response":"b"}', "system_prompt_response", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ('{"instruction":"a","input":"","output":"b"}', "instruction_input_output", [("user", "a"), ("assistant", "b")]),
    ('{"instruction":"a","input":"i","output":"b"}', "instruction_input_output", [("user", "a\n\ni"), ("assistant", "b")]),
    ('{"question":"a","answer":"b"}', "question_answer", [("user", "a"), ("assistant", "b")]),
    ('{"turns":[{"speaker":"Bot","text":"a"}]}', "speaker_text", [("assistant", "a")]), ('{"x":1}', None, []), ("nonsense {", None, []), (None, None, [])])
def test_layouts(spark, record, layout, turns):
    got = chat.canonical_turns(spark.createDataFrame([(1, record)], "conv_id long, record string")).first()
    assert (got["layout"], [(t["role"], t["text"]) for t in got["turns"]]) == (layout, turns)


NASTY = ["", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", r"<\|im_end|> <\\s> \\", "<", "[", "<|", "a\nb\n", "<<SYS>>x<</SYS>>", r"\<|im_start|>", "\u00e9\U0001f600" * 9,
         "<<|im_end|>", "<|im_end|<|im_end|>>", "<|im_end|>" * 3, "\\n\\s"]


def test_chat_round_trip(spark):
    rows = [(i, t, role, text) for i, (role, text) in enumerate((r, x) for x in NASTY for r in ("assistant", "a\nb\\n<|im_end|>\\s", None)) for t in (0,)]
    rows += [(900, k, "assistant" if k % 2 else "user", x) for k, x in enumerate(NASTY)] + [(901, 0, "user", None), (901, 0, "user", None), (None, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    full = chat.read_back(chat.format_turns(chat.canonical_turns(chat.records_of(df)))).collect()
    got = {x["conv_id"]: x for x in full}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t["role"], t["text"]) for t in got[conv]["read_turns"]] == [(r, x) for _, r, x in mine]
        assert got[conv]["read_loss"] == "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv]["formatted"].count("<|im_end|>") == len(mine)
    assert chat.digest(chat.format_turns(chat.canonical_turns(chat.records_of(df.where("false"))))).count() == 0


# ---- contamination ----------------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    """Verbatim items in documents, found by search for the words themselves."""
    import re

    docs, items = load(spark, SF_DIR, "documents"), load(spark, SF_DIR, "benchmark")
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    texts = {x["doc_id"]: " " + " ".join(words(x["text"])) + " " for x in docs.collect()}
    wanted = {(d, i["item_id"]) for i in items.collect() for d, t in texts.items() if f" {' '.join(words(i['text']))} " in t}
    got = {(x["doc_id"], x["item_id"]) for x in contamination.leaks(docs, items).collect()}
    assert wanted and wanted <= got
    assert len(got - wanted) <= 0.1 * len(wanted)


def test_bounds_lose_no_item():
    """What the index retrieves from random passages is what scoring every item gives."""
    rng = np.random.default_rng(3)
    vocabulary = rng.integers(1, 2**63, 400, dtype=np.uint64)
    zipf = 1 / np.arange(1, 401)
    draw = lambda n: rng.choice(vocabulary, n, p=zipf / zipf.sum())
    items = [draw(rng.integers(5, 40)) for _ in range(60)]
    index = contamination.build_index(list(range(60)), items, [len(w) - 2 for w in items])
    docs = [np.concatenate([draw(rng.integers(0, 90)), items[rng.integers(60)], draw(rng.integers(0, 90))]) for _ in range(80)]
    got = {(d, index.item_ids[i]) for d, i, *_ in contamination.search(index, np.concatenate(docs), np.array([len(d) for d in docs]))}
    place = {int(x): i for i, x in enumerate(index.item_ids)}
    weight = np.zeros((len(index.terms), 60))
    for t in range(len(index.terms)):
        for p in range(index.ptr[t], index.ptr[t + 1]):
            weight[t, index.items[p]] = index.weights[p]
    wanted = set()
    for d, words in enumerate(docs):
        n = max(1, -(-len(words) // 32))
        for w in range(max(1, n - 2)):
            lo, hi = w * 32, min(len(words), (w + 3) * 32)
            known = np.unique(np.searchsorted(index.terms, words[lo:hi][np.isin(words[lo:hi], index.terms)]))
            score = weight[known].sum(axis=0)
            around = words[max(0, lo - 32):hi + 32]
            for item in range(60):
                i = place[item]
                if score[i] >= index.need[i] * (1 - 1e-9) and min(contamination.overlap(index.questions[i], around), contamination.overlap(index.answers[i], around)) >= 0.6:
                    wanted.add((d, item))
    assert wanted and got == wanted


def test_odd_leaks(spark, odd, none):
    items = spark.createDataFrame([(0, prose(2, 60)), (1, None), (2, ""), (3, prose(2, 60)), (4, "never seen words here")], "item_id long, text string")
    got = contamination.leaks(clashing(odd), clashing(items))
    assert sorted((x["doc_id"], x["item_id"]) for x in got.collect()) == [(4, 0), (4, 3), (10, 0), (10, 0), (10, 3), (10, 3)]
    assert sorted((x["doc_id"], x["item_id"]) for x in contamination.leaks(odd, items, max_items=1).collect()) == [(4, 0), (4, 3), (10, 0), (10, 0), (10, 3), (10, 3)]
    assert contamination.leaks(none, items).count() == 0 and contamination.leaks(odd, items.where("false")).count() == 0
    kept = contamination.drop_leaks(clashing(odd), items)
    assert kept.count() == odd.count() - 3 and kept.columns == clashing(odd).columns


# ---- fingerprints -----------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    docs = load(spark, SF_DIR, "documents")
    rows = sorted(((x["doc_id"], x["text"] or "") for x in docs.collect()), reverse=True)
    got = {x["doc_id"]: x for x in fingerprints.fingerprint_documents(docs).collect()}
    value = lambda d: int(got[d]["fingerprint"], 16)
    by_text: dict[str, set] = {}
    for i, (d, t) in enumerate(rows):
        other, n = rows[(i + 1) % len(rows)], len(t) // 3
        edited = t[:len(t) - n] + other[1][:n]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d]["near_next"] == 1 - bin(value(d) ^ value(other[0])).count("1") / 64
        assert got[d]["near_edited"] == 1 - bin(value(d) ^ int(got[d]["edited_fingerprint"], 16)).count("1") / 64
        by_text.setdefault(t, set()).add(value(d))
    assert all(len(v) == 1 for v in by_text.values())
    every = sorted({value(d) for d in got})
    for d, x in got.items():
        assert x["n_links"] == sum(1 <= bin(value(d) ^ v).count("1") <= 3 for v in every)


@pytest.mark.parametrize("radius,blocks", [(1, 3), (3, 6), (4, 6)])
def test_all_within_the_radius(spark, radius, blocks):
    r = random.Random(radius)
    values = []
    for _ in range(60):
        v = r.getrandbits(64)
        for _ in range(4):
            w = v
            for b in r.sample(range(64), r.randint(0, radius + 1)):
                w ^= 1 << b
            values.append(w - (1 << 64) if w >> 63 else w)
    distinct = sorted(set(values))
    wanted = {(a, b) for a in distinct for b in distinct if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
    got = fingerprints.within_radius(spark.createDataFrame([(v,) for v in values], "fp long"), radius, blocks)
    assert {tuple(x) for x in got.collect()} == wanted


def test_odd_fingerprints(odd, none):
    got = fingerprints.fingerprint_documents(clashing(odd)).collect()
    assert len(got) == odd.count() and {x["n_chars"] for x in got if x["doc_id"] == 5} == {0}
    assert fingerprints.fingerprint_documents(none).count() == 0
    alone = fingerprints.fingerprint_documents(odd.where("doc_id = 4")).first()
    assert alone["near_next"] == 1.0


# ---- toxicity ---------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    path = SF_DIR.replace("sf0.001", "sf0.1")
    docs, labels = load(spark, path, "documents"), load(spark, path, "labels")
    model = toxicity.train(*toxicity.training_sample(docs, labels))
    got = toxicity.score_documents(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").select("doc_id", "score", "predicted", "toxic").toPandas()
    got = got[[zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]]
    assert (got.predicted == got.toxic).mean() > 0.95
    rank = got.score.rank()
    pos = got.toxic == 1
    assert (rank[pos].mean() - (pos.sum() + 1) / 2) / (~pos).sum() > 0.93
    assert got[got.predicted == 1].toxic.mean() > 0.9


def test_offending_sentences(spark):
    texts = [f"{prose(i, 8)}. {'you ' + ('scum' if i % 4 == 0 else 'lot')}. {prose(i + 500, 8)}." for i in range(200)]
    model = toxicity.train(texts, [int(i % 4 == 0) for i in range(200)])
    got = toxicity.score_documents(spark.createDataFrame([(1, "All is well. You scum here. Good day."), (2, "All is well.")], "doc_id long, text string"), model).collect()
    assert got[0]["offending"] == [1] and got[0]["worst_sentence"] == "You scum here." and got[0]["predicted"] == 1 and got[1]["predicted"] == 0
    assert model.score("x. y") == pytest.approx(1 - np.prod([1 - p for _, p in model.sentence_scores("x. y")]))


def test_odd_toxicity(odd, none):
    model = toxicity.train(["bad word"] * 5 + ["fine"] * 20, [1] * 5 + [0] * 20)
    got = toxicity.score_documents(clashing(odd), model).collect()
    assert len(got) == odd.count() and all(0 <= x["score"] <= 1 for x in got) and toxicity.score_documents(none, model).count() == 0
    assert toxicity.train([], []).score("x") >= 0 and toxicity.train(["a"], [1]).score("") > 0.5
    assert toxicity.drop_toxic(clashing(odd), model).columns == clashing(odd).columns


# ---- mixing -----------------------------------------------------------------------------------------------------------


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 5, None: 300, "Z": 50}
    got = {x["source"]: x["target"] for x in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, total = {}, set(order), sum(sizes.values())
    while True:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        open_ -= over
    target.update(share)
    assert got == pytest.approx(target)


def test_mix_meets_its_targets(spark):
    docs = load(spark, SF_DIR.replace("sf0.001", "sf0.01"), "documents")
    got = mixing.mix(docs).toPandas()
    for _, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= max(own["size"].max() / 2, 0.02 * own.target.iloc[0])
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.mix(docs.repartition(7), buckets=64).toPandas()
    assert sorted(map(tuple, got[["doc_id", "taken"]].values)) == sorted(map(tuple, again[["doc_id", "taken"]].values))
    assert mixing.mixed_documents(docs).count() == (got.copies + got.extra).sum()


def test_unequal_weights(spark):
    rows = [(i, "w " * 10, "s", 3.0 if i % 2 else 1.0) for i in range(400)] + [(1000, "w " * 4000, "t", 1.0)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, q double"), weights=(1, 3), weight_col="q").toPandas()
    own = got[got.source == "s"]
    assert own[own.doc_id % 2 == 1].taken.sum() > 2 * own[own.doc_id % 2 == 0].taken.sum()


def test_documents_of_a_source_have_unequal_odds(spark):
    """Short documents are taken more often than long ones, by the fourth root of their sizes; few of one size stay below the cap."""
    rows = [(i, "w " * (16 if i % 2 else 256), "a", ) for i in range(2000)] + [(9000 + i, "w " * 300, "b") for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 4)).toPandas()
    own = got[got.source == "a"]
    short, long = (own[own["size"] == n] for n in (16, 256))
    rate = lambda x: (x.copies + x.extra).mean()
    assert rate(short) == pytest.approx(2 * rate(long), rel=0.15)
    for _, x in got.groupby("source"):
        assert abs(x.taken.sum() - x.target.iloc[0]) <= 150


def test_rows_of_one_id_are_spread(spark):
    """A thousand rows without an id, and a thousand of one id, are not taken or left as one block."""
    rows = [(None, f"w{i} " * 10, "a") for i in range(1000)] + [(7, f"w{i} " * 10, "b") for i in range(1000)] + [(8, "x " * 10, "b")] * 50
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 3)).toPandas()
    for _, x in got.groupby("source"):
        assert abs(x.taken.sum() - x.target.iloc[0]) <= 5 and x.extra.sum() not in (0, len(x))


def test_sources_are_not_mixed_up(spark):
    """One id and text under two sources are two documents."""
    docs = spark.createDataFrame([(1, "a b c", s) for s in ("x", "y")] + [(i, f"w{i} " * 30, "y") for i in range(2, 40)], "doc_id long, text string, source string")
    wanted = {(r["doc_id"], r["source"]): r["copies"] + r["extra"] for r in mixing.mix(docs).collect() if r["copies"] + r["extra"]}
    assert Counter((r["doc_id"], r["source"]) for r in mixing.mixed_documents(docs).collect()) == wanted


def test_stages_keep_clashing_columns(spark, odd):
    """Columns with the names of outputs stay as they are."""
    docs = clashing(odd)
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped_"] and {r["n_lines"] for r in out.collect()} == {"x"}
    assert lines.kept_lines(docs).columns == docs.columns and lines.kept_lines(docs).count() == docs.count()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "copy_no_"] and {r["copy_no"] for r in mixed.collect()} == {"x"}
    assert near.drop_near_copies(docs).columns == docs.columns


@pytest.mark.parametrize("n", [15, 16, 17])
def test_the_edit_bound_begins_at_its_length(spark, n):
    rows = [(1, "a" * n), (2, "a" * (n - 1) + "b")]
    got = {r["doc_id"]: r["text"] for r in lines.kept_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "" if n >= 16 else rows[1][1]}


def test_odd_mix(odd, none):
    got = mixing.mix(clashing(odd)).collect()
    assert len(got) == odd.count() and all(x["taken"] == 0 for x in got if x["size"] == 0)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.select(F.sum(F.size(F.split("text", " ")))).first()[0] >= 0


# ---- language model ---------------------------------------------------------------------------------------------------


def scores_by_hand(rows):
    """rows: (doc_id, text).  Each is scored by the counts of all others, from three words down."""
    words = [(t or "").lower().split() for _, t in rows]
    grams = lambda ws, k: Counter(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    every = sum((grams(ws, k) for ws in words for k in (1, 2, 3)), Counter())
    total, out = sum(map(len, words)), []
    for (d, _), ws in zip(rows, words):
        own = sum((grams(ws, k) for k in (1, 2, 3)), Counter())
        rest = lambda g: every[g] - own[g]
        value = 0.0
        for i in range(len(ws)):
            g = tuple(ws[max(0, i - 2):i + 1])
            while len(g) > 1 and not rest(g):
                g, value = g[1:], value + np.log(0.4)
            value += np.log(rest(g) / rest(g[:-1])) if len(g) > 1 else np.log(max(rest(g), 0.4) / max(total - len(ws), 1))
        out.append((d, len(ws), value))
    return out


@pytest.mark.parametrize("frequent,salts", [(0.02, 64), (0.3, 3), (2.0, 1)])
def test_scores_equal_brute_force(spark, monkeypatch, frequent, salts):
    """Whichever n-grams are dealt out by document."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "SALTS", salts)
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("a b c d the of x1 x2 x3 x4 x5 x6 x7 x8".split()) for _ in range(r.randint(0, 40)))) for i in range(150)]
    rows += [(500, None), (None, "a b c"), (3, "a b"), (3, "a b"), (600, "never seen"), (601, "  One"), (602, "\tThe of\n"), (603, "x1 x1 x1 x1 x1")]
    got = sorted(((x["doc_id"] if x["doc_id"] is not None else -1, x["n_words"], x["log_score"]) for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    wanted = sorted((d if d is not None else -1, n, s) for d, n, s in scores_by_hand(rows))
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    np.testing.assert_allclose([g[2] for g in got], [w[2] for w in wanted], atol=2e-6)


def test_a_single_document_has_no_model(spark):
    got = lm.score(spark.createDataFrame([(1, "a b c")], "doc_id string, text string")).first()
    assert got["log_score"] == pytest.approx(6 * np.log(0.4), abs=1e-5)


def test_odd_scores(odd, none):
    got = lm.score(clashing(odd)).collect()
    assert len(got) == odd.count() and lm.score(none).count() == 0


# ---- urls -------------------------------------------------------------------------------------------------------------

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://A.Example.com/en/x?y#z", "a.example.com", "/en/x", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://com", "com", "", None, "allow"), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://b.net/es/?q", "b.net", "/es/", "net/es/", "block"), ("http://b.net?x/es/", "b.net", "", None, "allow"), ("http://b.net#/es/", "b.net", "", None, "allow"), ("x.net/es/", "", "", None, "allow"),
    (None, "", "", None, "allow"), ("a://b.net/p://c/es/", "b.net", "/p://c/es/", None, "allow")])
def test_rules(spark, url, host, path, rule, verdict):
    got = urls.filter_urls(clashing(spark.createDataFrame([(1, url, None)], "page_id long, url string, html string")), RULES).first()
    assert (got["host"], got["path"], got["rule"], got["verdict"]) == (host, path, rule, verdict)


def test_aliases(spark):
    link = '<head><link rel="canonical" href="{}"></head>'.format
    pages = [(1, "http://a.org/1", link("http://b.net/es/x")), (2, "http://c.org/2#top", '<meta http-equiv="refresh" content="0; url=http://a.org/1">'), (3, "http://d.org/3", link("/4")),
             (4, "http://d.org/4", None), (5, "http://e.org/5", link("http://f.com/y")), (6, "http://g.org/6", None), (7, "http://f.com/y", ""), (8, "http://c.org/2", None), (9, "http://h.org/", link("http://h.org/"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {x["page_id"]: (x["verdict"], x["by_alias"]) for x in urls.filter_urls(df, RULES).collect()}
    assert got == {1: ("block", True), 2: ("block", True), 3: ("allow", False), 4: ("allow", False), 5: ("allow", True), 6: ("allow", False), 7: ("allow", False), 8: ("block", True), 9: ("allow", False)}
    import duckdb

    from strandflow.llm import queries
    from tests.compare import assert_same

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [*pages, (10, None, None), (11, "no scheme", "")])
    assert_same(urls.filter_urls(df.unionByName(spark.createDataFrame([(10, None, None), (11, "no scheme", "")], df.schema)), RULES), queries.ORACLES["op10_url_filters"], con)
    more = spark.createDataFrame([("http://e.org/5", "http://d.org/4"), ("http://d.org/4", "http://z.net/fr/")], "a string, b string")
    got = {x["page_id"]: x["verdict"] for x in urls.filter_urls(df, RULES, redirects=more).collect()}
    assert got[4] == "allow" and got[3] == "allow" and got[5] == "allow"


@pytest.mark.parametrize("html_text,links", [
    ('<link rel=canonical href="b.html">', ["http://a.org/d/b.html"]), ('<link rel="shortlink Canonical" href="../x?y=1">', ["http://a.org/x?y=1"]), ("<link href='?id=3' rel='canonical'>", ["http://a.org/d/p?id=3"]),
    ('<!-- <link rel="canonical" href="/no"> --><link rel="canonical" href="//b.net/es/&#38;q&quot;">', ['http://b.net/es/&q"']), ('<script>"<link rel=canonical href=/no>"</script>', []), ("<!-- <link rel=canonical href=/no>", []),
    ('<LINK REL=CANONICAL HREF=/one><link rel="canonical" href="/two">', ["http://a.org/one", "http://a.org/two"]), ('<link rel="stylesheet" href="/canonical.css">', []), ('<link rel="canonical" title=">" href="/gt">', ["http://a.org/gt"]),
    ("""<meta http-equiv=refresh content="0; url='http://b.net/es/1'"><meta content='5;URL=z' http-equiv="Refresh">""", ["http://b.net/es/1", "http://a.org/d/z"]), ('<meta http-equiv="refresh" content="30">', []),
    ('<base href="http://c.com/e/"><link rel="canonical" href="f">', ["http://c.com/e/f"]), ('<link rel="canonical" href="http://[bad">', []), ("<link rel=canonical", []), ('<div data-rel="canonical" href="/no"><link data-rel="canonical" href="/no">', [])])
def test_links_of_pages(spark, html_text, links):
    assert urls.links_of("http://a.org/d/p", html_text) == links
    df = spark.createDataFrame([("http://a.org/d/p", html_text), (None, html_text), ("http://a.org/d/p", None)], "url string, html string")
    assert [(r["a"], r["b"]) for r in urls.page_links(df).collect()] == [("http://a.org/d/p", x) for x in links]


def test_a_large_graph_equals_brute_force(spark):
    """Hubs, long chains, cycles and pairs of redirects, with blocked and allowed urls in them, against union-find."""
    r = random.Random(12)
    url = lambda i: f"http://h{i % 97}.{('org', 'net', 'com', 'info')[i % 4]}/{('es', 'x', 'y', 'fr')[(i // 4) % 4]}/{i}"
    edges = [(0, i) for i in range(1, 1500)] + [(2000 + i, 2001 + i) for i in range(800)] + [(3000 + i, 3000 + (i + 1) % 50) for i in range(50)]
    edges += [(4000 + i, 4000 + i // 2 * 2) for i in range(1000)] + [(r.randint(5000, 7000), r.randint(5000, 7000)) for _ in range(1200)]
    head = list(range(7500))

    def find(x):
        while head[x] != x:
            head[x] = x = head[head[x]]
        return x

    for x, y in edges:
        head[find(x)] = find(y)
    own = {i: next((a for a, h, p in sorted(RULES, key=lambda q: -len(q[1] + q[2])) if url(i).split("/")[2].endswith(h) and ("/" + url(i).split("/", 3)[3]).startswith(p)), None) for i in range(7500)}
    said: dict[int, set] = {}
    for i in range(7500):
        said.setdefault(find(i), set()).add(own[i])
    wanted = {i: own[i] or ("allow" if "allow" in said[find(i)] else "block" if "block" in said[find(i)] else "allow") for i in range(7500)}
    pages = spark.createDataFrame([(i, url(i)) for i in range(7500)], "page_id long, url string")
    redirects = spark.createDataFrame([(url(x), url(y)) for x, y in edges], "a string, b string")
    got = {x["page_id"]: x["verdict"] for x in urls.filter_urls(pages, RULES, redirects=redirects, html_col=None).collect()}
    assert got == wanted and len(set(wanted.values())) == 2


def test_many_rules_are_a_table(spark, monkeypatch):
    """The same verdicts from an expression and from a table of rules, ties included."""
    r = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "x.org", "org", "y.x.org"]
    rules = [(r.choice(("allow", "block")), h, p) for h in hosts for p in ("", "/", "/e", "/en/", "/en/x") if r.random() < 0.8]
    pages = spark.createDataFrame([(i, f"http://{r.choice(['', 'w.', 'b.'])}{r.choice(hosts)}{r.choice(['', '/', '/e', '/en/x/1', '/fr'])}") for i in range(300)] + [(900, None)], "page_id long, url string")
    few = {x["page_id"]: (x["rule"], x["verdict"]) for x in urls.filter_urls(pages, rules, html_col=None).collect()}
    for most, sent in ((5, 200_000), (5, 5)):
        monkeypatch.setattr(urls, "MAX_RULES", most)
        monkeypatch.setattr(urls, "MAX_BROADCAST", sent)
        assert {x["page_id"]: (x["rule"], x["verdict"]) for x in urls.filter_urls(pages, rules, html_col=None).collect()} == few


@pytest.mark.parametrize("kind,buckets", [("long", 1), ("long", 7), ("string", 7), ("long", 300), ("string", 300)])
def test_the_next_document_by_any_id(spark, kind, buckets):
    """Every row's next, whatever the type of the ids and the number of buckets, with null and repeated ids."""
    r = random.Random(buckets)
    ids = r.sample(range(100_000), 590) + [77_777_777] * 3 + [None] * 7
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = {x["text"]: (x["doc_id"], x["next_text"]) for x in fingerprints.with_next(df, rows_per_bucket=600 // buckets).collect()}
    assert len(got) == 600
    chain, at = [], "text 0"
    for _ in range(600):
        chain.append(got[at][0])
        at = got[at][1]
    assert at == "text 0" and len(chain) == 600
    turn = max(range(600), key=lambda i: (chain[i - 1] is None and chain[i] is not None, i))
    chain = chain[turn:] + chain[:turn]
    known = [c for c in chain if c is not None]
    assert known == sorted(known, reverse=True) and chain[len(known):] == [None] * 7
