"""Chat formatting, filter interaction and source divergence against brute force, with their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from addrloom.llm import chat_format, divergence, filter_audit
from addrloom.llm.chat_format import Escape, Flatten, Template, parse

CHAT = "conv_id bigint, turn bigint, role string, text string, formatted string, loss int"
SAYS = "</s>[INST] ok [/INST]"


def chats():
    rng = random.Random(5)
    bits = ["[", "<", "\\", "INST]", "[INST]", "</s>", "[/INST]", "[\\INST]", "[IMAGE:0]", "é", "\U0001f600", "\n", " word", "[ROLE]", "[SAYS]", "/s>", "]"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool[SAYS]", None]), "".join(rng.choices(bits, k=rng.randrange(12)))) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(7, t, "assistant" if t % 2 else "user", f"turn {t} [INST]" * 20) for t in range(900)]  # one long conversation
    rows += [(None, 1, "user", "no id"), (None, None, "assistant", None), (3, 2, "assistant", "again"), (3, 2, "assistant", "again"), (3, None, "user", ""), (99, 0, "assistant", "long " * 60_000)]
    rng.shuffle(rows)
    return [(*r, "clash", 1) for r in rows]


def expected_chats(rows):
    out = defaultdict(list)
    for c, t, role, text, *_ in [*rows, (-1, 0, "user", SAYS), (-1, 1, "assistant", SAYS)]:
        out[c].append((t is not None, t or 0, role or "", text or ""))
    found = {}
    for c, turns in out.items():
        turns.sort(key=lambda x: x[:3])
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        found[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return found


@pytest.fixture(scope="module")
def written(spark):
    """Formatted with pieces of 2,000 code points, in all orders of equal turns that the operator may choose."""
    rows = [r for r in chats() if not (r[0] in range(60) and Counter((x[0], x[1], x[2]) for x in chats())[(r[0], r[1], r[2])] > 1 and r[3] != "again")]
    turns = spark.createDataFrame(rows, CHAT).repartition(5)
    return rows, chat_format.format_chats(turns.withColumn("parts", chat_format.text_part(turns["text"])), piece=2000)


def test_chats_read_back(spark, written):
    rows, table = written
    want = expected_chats(rows)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_chats(table).collect()}
    del want[-1]
    assert got == want
    assert table.where("conv_id = 7").count() > 5  # the long conversation goes over several rows
    assert table.where("whole").count() > 10


def test_chat_query(spark):
    rows = [(1, 0, "user", "a[INST]", "x", 1), (1, 1, "assistant", None, "x", 1), (2, 5, "assistant", "é</s>", "x", 1), (2, 1, "user", "q", "x", 1)]
    got = {r.conv_id: r for r in chat_format.op11_chat_format(spark, spark.createDataFrame(rows, CHAT)).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == expected_chats(rows)
    assert got[2].loss_chars == 5 and got[-1].loss_chars == len(SAYS)
    assert [r.conv_id for r in chat_format.op11_chat_format(spark, spark.createDataFrame([], CHAT)).collect()] == [-1]


_alphabet = st.lists(st.sampled_from(["[", "<", "\\", "INST]", "/INST]", "/s>", "s", "IMAGE:1]", "/DOCUMENT:12]", "IMAGE:", "1", "]", "ROLE]", "é", "\n"]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[SAYS]", ""]), st.lists(_alphabet, max_size=3)), max_size=4))
def test_escapes_are_reversible(turns):
    template = Template()
    escape = Escape(template)
    flatten, piece = Flatten(template, escape), chat_format._Piece()
    for role, texts in turns:
        piece.add(0, role, [{"kind": "text", "text": t} for t in texts], flatten, template)
    formatted = "".join(piece.out)
    assert list(parse(formatted, template, escape)) == [(role, "".join(texts)) for role, texts in turns]
    assert "".join(escape.unescape(formatted[s["lo"] : s["hi"]]) for s in piece.loss) == "".join("".join(t) for r, t in turns if r == "assistant")
    for _, texts in turns:
        assert not template.control().search(escape.escape("".join(texts)))


def test_typed_parts(spark):
    none = {"text": None, "ref": None, "width": None, "height": None, "seconds": None}
    leaf = lambda kind, **x: {"kind": kind, **none, **x}
    pages = [leaf("text", text="page ["), leaf("text", text="INST]"), leaf("image", ref="p.png", width=15, height=14)]
    parts = [leaf("text", text="see [IMAGE:0] "), leaf("image", ref="a.png", width=28, height=29), leaf("audio", ref="b.wav", seconds=1.5), leaf("document", ref="c.pdf", pages=pages), leaf("document", ref="d.pdf"), leaf("video", ref="e"), leaf(None, text="end")]
    parts = [{"pages": None, **p} for p in parts]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", parts[:3]), (1, 2, "assistant", None), (2, 0, "user", [])]
    t = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {chat_format.PARTS}")
    table = chat_format.format_chats(t)
    one = table.where("conv_id = 1").collect()
    text, attached = "".join(r.formatted for r in one), [a for r in one for a in r.attachments]
    user = r"see [\IMAGE:0] [IMAGE:0][AUDIO:1][DOCUMENT:2]page [\INST][IMAGE:3][/DOCUMENT:2][DOCUMENT:4][/DOCUMENT:4][FILE:5]end"
    assert text == rf"[INST]{user}[/INST][ANSWER]see [\IMAGE:0] [IMAGE:0][AUDIO:1]</s>[ANSWER]</s>"
    assert [(a.turn, a.number, a.kind, a.ref, a.tokens) for a in attached] == [(0, 0, "image", "a.png", 6), (0, 1, "audio", "b.wav", 38), (0, 2, "document", "c.pdf", 0), (0, 3, "image", "p.png", 2), (0, 4, "document", "d.pdf", 256), (0, 5, "file", "e", 0), (1, 0, "image", "a.png", 6), (1, 1, "audio", "b.wav", 38)]
    learned = "".join(r.formatted[s.lo : s.hi] for r in one for s in r.loss)
    assert learned == r"see [\IMAGE:0] "
    got = {r.conv_id: r for r in chat_format.read_chats(table).collect()}
    assert (got[1].n_attachments, got[1].expanded_tokens, got[2].n_turns, got[2].n_attachments) == (8, 346, 1, 0)


AUDIT = "doc_id bigint, text string, lang string, source string, part string, n int, good int, own int, mask int"


def audited(rows, labels):
    """All orders applied one after the other, document by document."""
    first, marks = {}, defaultdict(lambda: [False, False])
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        if i is not None:
            marks[i][0] |= q == 1
            marks[i][1] |= x == 1
    fails = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        fails.append((lang or "", f, *(marks[i] if i is not None else (False, False))))
    out = {}
    for part in {x[0] for x in fails}:
        removed_sum = Counter()
        mine = [x for x in fails if x[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                removed_sum[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x[1][f] for x in mine) - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_sum[order[step - 1]])
    return out


def audit_rows():
    rng = random.Random(3)
    texts = [None, "", " \n", "A # b", "x " * 300, "word " + " ".join(f"w{k}" for k in range(250)), "UPPER " * 210, "é日本 " * 205 + "|", "\U0001f600" * 50, "a\x0bb\x0cc\x1cd $", "l " * 40_000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["en", None, "", "fr"]), "s", "x", 1, 2, 3, 4) for _ in range(150)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    return rows, labels


def test_filter_audit(spark):
    rows, labels = audit_rows()
    docs, marks = spark.createDataFrame(rows, AUDIT), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.op12_filter_audit(docs, marks).collect()}
    assert got == audited(rows, labels)
    assert filter_audit.op12_filter_audit(docs.limit(0), marks).count() == 0
    assert filter_audit.op12_filter_audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_copies_and_rows_without_id_are_split(spark):
    """A text with very many copies and rows without an id are a few rows before the windows over texts."""
    docs = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same' ELSE 'other' || id END AS text", "'en' AS lang")
    masks = {r["mask"]: r.n for r in filter_audit.mask_counts(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()}
    same = [i for i in range(0, 20_000, 2) if i % 3]
    assert masks == {1: 20_000 - len(same) + 1, 17: len(same) - 1}


def test_polynomial_is_the_game():
    rng = random.Random(1)
    counts = {m: rng.randrange(5) * 10**14 for m in range(32)}
    p = filter_audit.RemovalPolynomial(counts)
    removed = lambda s: sum(n for m, n in counts.items() if m & s)
    assert all(p.corner(s) == removed(s) for s in range(32))
    for k in range(5):
        gains = []
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(k)])
            gains.append(removed(before | 1 << k) - removed(before))
        assert p.shapley(1 << k) == Fraction(sum(gains), 120)


def diverged(rows, min_docs):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = {}
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for *_, ts in mine for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        count = lambda who: Counter(t for _, s, ts in mine if who in (None, s) for t in ts)
        share = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        sources = sorted({d[1] for d in mine})
        counts = {s: count(s) for s in sources}
        p, q = {s: share(counts[s]) for s in sources}, share(count(None))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                for rank, (v, item) in enumerate(sorted(found)[:most], 1):
                    out[lang, s, part, item.decode()] = (-v, rank)
    return out


def divergence_rows():
    rng = random.Random(9)
    words = ["Alpha", "beta", "été", "Éa", "日本", "x1y", "a_b", "\U0001f600", "g" * 300, "tie", "eit", "Zed", "ab\x7fcd", "q r", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(" ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randrange(30))), rng.choice(["en", None, "", "de"]), rng.choice(["s1", "s2", None, "S1", "é"])) for _ in range(120)]
    rows += [(None, "en", "empty"), ("", "lone", "only"), ("12 34", "fr", "a"), ("few", "fr", "b"), ("beta " * 50_000, "en", "s1")] + [rows[0]] * 15
    return rows


def test_divergence(spark):
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "text string, lang string, source string, n int, q int, value int, term string")
    for min_docs, cells in ((10, divergence.CELLS), (3, 40)):  # many small blocks give the same
        got = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in divergence.divergence(docs, min_docs, cells).collect()}
        assert got == diverged(rows, min_docs)
    assert divergence.op13_divergence(docs.limit(0)).count() == 0


def test_terms_of_long_texts():
    text = ("Été, a1b\x00c-D " * 200_000).encode()
    assert Counter(t for ts in divergence.terms_of(text) for t in ts) == Counter({"Été".encode(): 200_000, b"a": 200_000, b"b": 200_000, b"c": 200_000, b"d": 200_000})
    assert sum(len(x) for x in divergence.terms_of(b"a" * 3_000_000)) == 1
    assert max(sum(map(len, ts)) for ts in divergence.terms_of(b"ab " * 2_000_000)) <= divergence.WINDOW


def test_pair_sums_in_slabs(monkeypatch):
    p = np.random.default_rng(2).integers(1, 10**9 + 1, (17, 30))
    want = [[sum((int(x) - int(y)) ** 2 // (int(x) + int(y)) for x, y in zip(a, b)) for b in p] for a in p]
    for cells in (1, 2000, 10**7):
        monkeypatch.setattr(divergence, "PAIR_CELLS", cells)
        assert divergence.pair_sums(p).tolist() == want


def test_shares_of_large_counts(spark):
    cases = [(0, 2), (5 * 10**13, 2 * 10**14), (10**14, 10**14 + 3), (12_345_678_901_234, 98_765_432_109_876)]
    got = spark.createDataFrame(cases, "n bigint, total bigint").select("n", "total", divergence.share("n", "total").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (r.n + 2) // r.total for r in got]


