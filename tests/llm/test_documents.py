import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestone.llm import decontaminate, jaccard, lm, pii, quality, rules, substring
from lodestone.llm.common import only, table
from lodestone.llm.wordhash import hashed


def frame(spark, rows, extra="row string, text_ int"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"doc_id long, text string, {extra}")


def words(r, n, size=60):
    return " ".join(f"w{x}" for x in r.integers(0, size, n))


EDGE = [(None, "only the words of a row without an id are here to be read by all"), (1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1003, "one")]


# Quality rules


def test_rules_sql(spark, sf):
    got = rules.judge(only(table(spark, sf, "documents"), "doc_id", "text")).select("row.doc_id", *rules.MEASURES, "base_failed", "kept")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(rules.rules_sql())
    assert sorted(map(tuple, got.collect())) == sorted(tuple(dict(zip(want.columns, r))[c] for c in got.columns) for r in want.fetchall())


def test_rules_edges(spark):
    text = "a b c d e f a b c d e x\nsame line here\nsame line here\n\n###"
    rows = [(1, text), *EDGE]
    got = {(r["row"]["doc_id"], r["row"]["text"]): r for r in rules.judge(frame(spark, rows, "n_words string, kept int")).collect()}
    r = got[1, text]
    assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["n_symbols"]) == (19, 10, 1, 3) and r["base_failed"] and not r["kept"]
    assert got[1000, None]["n_words"] == 0 and not got[1000, None]["kept"]
    good = "the cat and the dog of a house is in that it for was on with as be by this"
    out = rules.keep_good(frame(spark, [(5, good), (6, "short")], "n_words string, barrier int"))
    assert out.columns == ["doc_id", "text", "n_words", "barrier"] and [x["doc_id"] for x in out.collect()] == [5]
    assert rules.keep_good(frame(spark, [])).count() == 0


def test_rules_on_labels(spark):
    d = "/root/testdata/sf0.01"
    judged = rules.judge(only(table(spark, d, "documents"), "doc_id", "text")).select("row.doc_id", "base_failed", "kept")
    rows = judged.join(table(spark, d, "labels"), "doc_id").filter("not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) >= 0.99 * len(good) and sum(not r["kept"] for r in rows if r["quality"] == 0) >= 0.9 * sum(r["quality"] == 0 for r in rows)


def test_rules_long_text(spark):
    r = rules.judge(frame(spark, [(1, "\n".join(f"w{i} x" for i in range(60_000)))])).first()
    assert r["n_words"] == 120_000 and r["n_repeat_words"] == 0 and r["n_dup_lines"] == 0


# Quality classifier


def test_gradient():
    m = quality.Model()
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    texts, labels = [b"hello there, world " * 30, b"### $$$ %%%", b""], np.array([1.0, 0.0, 1.0])

    def loss():
        logit, _ = m.forward(*quality.layout(texts), m.tables())
        return float(np.mean(np.log1p(np.exp(-np.where(labels == 1, logit, -logit)))))

    g = m.gradient(texts, labels)
    r = np.random.default_rng(0)
    for k in ("vote", "inner", "bias", "filter", "embed"):
        flat, grad = m.p[k].reshape(-1), g[k].reshape(-1)
        for i in np.argsort(-np.abs(grad))[:3].tolist() + r.integers(0, len(flat), 2).tolist():
            keep = flat[i]
            flat[i] = keep + 1e-4
            up = loss()
            flat[i] = keep - 1e-4
            down = loss()
            flat[i] = keep
            assert (up - down) / 2e-4 == pytest.approx(grad[i], abs=2e-3)


def test_classifier(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    model = quality.train(docs, table(spark, d, "labels"))
    rows = {r["doc_id"]: r for r in quality.classify(docs, model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    held = [(rows[r["doc_id"]]["score"], r["quality"]) for r in table(spark, d, "labels").collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert quality.classify(frame(spark, []), model).count() == 0
    edge = quality.classify(frame(spark, [*EDGE, (9, "x" * 200_001)], "score string, labels int"), model).collect()
    assert len(edge) == len(EDGE) + 1 and all(0 <= r["score"] <= 1 for r in edge)
    assert quality.classify(frame(spark, EDGE), None).first()["score"] == 0.5
    assert quality.train(docs, table(spark, d, "labels").limit(0)) is None


# Substring deduplication


def plain_parts(text):
    """The parts of a text as (begin, lower-cased words), by loops."""
    found = [(m.start(), m.end()) for m in re.finditer(r"\S+", text or "")]
    if not found:
        return []
    opens = [not i or "\n" in text[found[i - 1][1] : a] or text[found[i - 1][1] - 1] in ".!?" for i, (a, _) in enumerate(found)]
    low = [text[a:b].lower() for a, b in found]
    key = [0 if o else int(hashed([w])[0][0] >> np.uint64(1)) + 1 for o, w in zip(opens, low)]
    for i in range(len(key) - 7):
        opens[min(range(i, i + 8), key=lambda j: key[j])] = True
    at = [i for i, o in enumerate(opens) if o]
    return [(found[i - 1][1] if i else 0, low[i:j]) for i, j in zip(at, [*at[1:], len(low)])]


def plain_runs(parts):
    """(first part, part after the last, words) of the runs."""
    for i in range(len(parts)):
        for j in range(i + 3, len(parts) + 1):
            if sum(len(w) for _, w in parts[i:j]) >= 28:
                yield i, j, tuple(x for _, w in parts[i:j] for x in w)
                break


def test_substring(spark):
    r = np.random.default_rng(2)
    sentence = lambda: words(r, int(r.integers(1, 14)), 500).capitalize() + "."
    passage = " ".join(sentence() for _ in range(9))
    flat = words(r, 70, 40)
    rows = []
    for i in range(30):
        parts = [sentence() for _ in range(int(r.integers(0, 12)))]
        if i % 3 == 0:
            parts.insert(len(parts) // 2, passage)
        rows.append((i, " ".join(parts)))
    rows += [(50, f"Before. {flat}dr and. After it."), (51, f"Other words {flat}dr end. More."), (52, passage + "\n" + passage), (53, "la " * 90), (54, " \n la\u3000" + "la " * 70 + "\n"), (55, "\u0130 \u03a3\u03a3 " * 40), (56, "x " + "\u0130 \u03a3\u03a3 " * 40), (57, words(r, 20_000, 9000)), *EDGE]
    # Rows that share a doc_id, have none or are equal are texts of their own.
    other, third = (" ".join(sentence() for _ in range(9)) for _ in range(2))
    rows += [(70, "First. " + other), (70, other + " More."), (70, other + " More."), (None, third), (None, "Then. " + third), (None, third), (None, passage), (2, "Again. " + other)]
    got = {}
    for x in substring.remove_repeated(frame(spark, rows, "doc string, later int")).collect():
        got.setdefault((x["doc_id"]), []).append(x)
    seen, wanted, first_of = set(), {}, lambda i: substring.NULL_ID if i is None else i
    for i, t in sorted(rows, key=lambda x: first_of(x[0])):
        parts = plain_parts(t)
        gone, own = set(), set()
        for a, b, key in plain_runs(parts):
            if key in own or key in seen:
                gone |= set(range(a, b))
            own.add(key)
        seen |= own
        edges = [a for a, _ in parts] + [len(t or "")]
        want = t if not gone else "".join(t[edges[k] : edges[k + 1]] for k in range(len(parts)) if k not in gone)
        wanted.setdefault(i, []).append((want, len(parts), len(gone)))
    for i, xs in got.items():
        assert sorted(((x["text"], x["n_sentences"], x["n_removed"]) for x in xs), key=str) == sorted(wanted[i], key=str), i
    assert got.keys() == wanted.keys() and sum(n for _, _, n in wanted[70]) and sum(n for _, _, n in wanted[None])
    assert sum(passage in (x["text"] or "") for xs in got.values() for x in xs) == 1
    assert substring.remove_repeated(frame(spark, [])).count() == 0


@pytest.mark.parametrize("place", ["aligned", "unaligned", "bare"])
def test_substring_meets_every_passage(spark, place):
    """Two texts that share 51 words share a run, in each language and wherever the passage begins."""
    r = np.random.default_rng(5)
    of = {}
    for x in table(spark, "/root/testdata/sf0.01", "documents").collect():
        w = (x["text"] or "").split()
        if len(w) > 200:
            of.setdefault(x["lang"], []).append(w)
    assert len(of) == 4
    for texts in of.values():
        for _ in range(60):
            a, b, c = (texts[int(i)] for i in r.integers(len(texts), size=3))
            at, i, j = (int(r.integers(len(x) - 110)) for x in (a, b, c))
            if place == "aligned":
                at = next((k for k in range(at, len(a) - 51) if a[k - 1][-1] in ".!?"), at)
            own = [b[i : i + 50] + a[at : at + 51] + b[i + 50 : i + 100], c[j : j + 50] + a[at : at + 51] + c[j + 50 : j + 100]]
            if place == "bare":
                own = [["".join(filter(str.isalnum, w)) or "x" for w in x] for x in own]
            c = substring.cut([" ".join(x) for x in own])
            assert set(c.h1[: c.run_at[1]].tolist()) & set(c.h1[c.run_at[1] :].tolist())


# Language model


def plain_words(text):
    return (text or "").encode().lower().split()


def test_lm(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"{'a' if i % 2 else 'b'}{min(x, 80)}" for x in r.zipf(1.5, int(r.integers(0, 200))))) for i in range(150)] + EDGE
    rows += [(7000, "Long Text " * 30_000), (7001, "\u00c4 \u00e4 \u2003x y"), (7002, "z")]
    monkeypatch.setattr(lm, "HELD", 40)
    monkeypatch.setattr(lm, "OWN", 0.4)
    got = lm.learn_and_score(frame(spark, rows, "score string, uid int")).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            c.update(plain_words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    assert lm.OWN * n**lm.GROWTH < 60 < len(c)
    want = Counter()
    for i, t in rows:
        w = plain_words(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        want[i, held(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 5)] += 1
    assert want == Counter((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 5)) for x in got)
    assert sum(x["score"] for x in got) > sum(x["base_score"] for x in got) and all(x["score"] < 0 for x in got)
    assert lm.learn_and_score(frame(spark, [])).count() == 0


@pytest.mark.parametrize("group", [1 << 21, 3000])
def test_lm_does_not_depend_on_partitions(spark, monkeypatch, group):
    """One partition or many give the same model, of one group of documents or of several."""
    monkeypatch.setattr(lm, "GROUP", group)
    monkeypatch.setattr(lm, "SHARE", 0)
    r = np.random.default_rng(6)
    df = frame(spark, [(i, " ".join(f"w{min(x, 400)}" for x in r.zipf(1.3, 60))) for i in range(400)])
    one, many = ({x["doc_id"]: x["score"] for x in lm.learn_and_score(d).collect()} for d in (df.coalesce(1), df.repartition(64)))
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], abs=1e-4) for k in one)


def test_lm_groups_keep_to_the_tokens():
    """Groups grow with the corpus, parameters that are averaged stay below half of its tokens, and no group is far larger than it must be."""
    before = 0
    for tokens in (1, 10**6, 10**8, 10**10, 10**12, 2 * 10**13):
        parameters = int(100 * lm.OWN * tokens**lm.GROWTH)
        n = lm.groups_of(tokens, parameters)
        assert n >= max(1, before) and (n == 1 or n * parameters <= tokens / lm.SHARE)
        assert tokens / n <= 4 * max(lm.GROUP, lm.SHARE * parameters)
        before = n


def test_lm_beats_the_base_on_held_out_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").repartition(64)
    s = lm.learn_and_score(docs).filter("held_out").selectExpr("sum(score) as s", "sum(base_score) as b", "sum(n_tokens) as n").first()
    assert s["s"] / s["n"] > s["b"] / s["n"] + 0.1


def test_lm_is_normalised(spark, monkeypatch):
    monkeypatch.setattr(lm, "OWN", 1)
    train = frame(spark, [(i, "x y z x y " + chr(97 + i % 9) * 3 + f" q{i}") for i in range(60)])
    counts, v = lm.count_words(train)
    assert 5 < v.own < len(v.keys)
    each = lm.encode(train.selectExpr("doc_id", "false as held_out", "text"), v).select("symbols")
    v.set_clusters(lm.clusters_of(lm.company(each, v), v.counts[: v.own]))
    assert v.clusters > 1 and sorted(np.concatenate(v.members)) == list(range(v.own))
    model = lm.train_model(each, v)
    every = np.arange(v.end + 1)
    for a, b in ((0, 1), (v.begin, v.begin), (v.own + 3, 2)):
        logs = model.logs(np.full(len(every), a), np.full(len(every), b), every)
        assert (10.0**logs).sum() == pytest.approx(1, abs=1e-4)
    # Within a kind, the shares of its words and of unknown ones.
    n = {r["key"]: (r["kind"], r["n"]) for r in counts.collect()}
    own = set(v.keys[: v.own].view(np.int64).tolist())
    for k in range(lm.KINDS):
        assert sum(c + 0.1 for key, (kind, c) in n.items() if kind == k and key not in own) + 0.1 == pytest.approx(v.mass[k])


# Personal data


def test_pii(spark):
    token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    rows = [
        (1, "a 4111 1111 1111 1111 and 4111-1111-1111-1111 or 4111111111111111; no 4111111111111112"),
        (2, "mail Ab.c9@mail5.example.com, call +1 (017) 555-7713, ip 10.0.0.255 not 10.0.0.256 nor 1.2.3.4.5"),
        (3, "born 1999-12-31 or 31.12.1999 or 12/31/1999, not 2024-02-30; ssn 123-45-6789 not 000-12-3456"),
        (4, f'token = "{token}" and TOKEN = "{token.upper()}"'),
        (5, "mail ab.c9@mail5.example.com and 10.0.0.255 again"),
        (6, "plain text v2.0 of 12 words"),
        *EDGE,
    ]
    got = {}
    for x in pii.pseudonymise(frame(spark, rows, "n_ip string, m int"), "one").collect():
        got[x["doc_id"]] = x
    one = got[1]["text"]
    cards = re.findall(r"\d[\d -]{14,}\d", one)
    digits = [re.sub(r"\D", "", x) for x in cards]
    luhn = lambda s: sum(int(x) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(x)] for i, x in enumerate(reversed(s))) % 10 == 0
    assert len(set(digits[:3])) == 1 and digits[0] != "4" + "1" * 15 and luhn(digits[0]) and digits[3] == "4111111111111112" and got[1]["n_card"] == 3
    assert "Ab.c9" not in got[2]["text"] and "555-7713" not in got[2]["text"] and "10.0.0.256 nor 1.2.3.4.5" in got[2]["text"]
    assert (got[2]["n_email"], got[2]["n_phone"], got[2]["n_ip"]) == (1, 1, 1) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4},", got[2]["text"])
    assert got[2]["text"].split()[1].rstrip(",") == got[5]["text"].split()[1] and got[5]["text"].split()[3] == re.search(r"ip (\S+)", got[2]["text"])[1]
    y, m, d = re.search(r"born (\d+)-(\d+)-(\d+)", got[3]["text"]).groups()
    assert f"or {d}.{m}.{y} or" in got[3]["text"] and "2024-02-30" in got[3]["text"] and "000-12-3456" in got[3]["text"] and got[3]["n_date"] == 3 and got[3]["n_ssn"] == 1
    assert token not in got[4]["text"] and got[4]["n_secret"] == 2
    assert got[6]["text"] == rows[5][1] and got[1000]["text"] is None and got[1001]["text"] == ""
    again = pii.pseudonymise(frame(spark, rows), key="other").filter("doc_id = 5").first()
    assert again["text"] != got[5]["text"]
    assert pii.pseudonymise(frame(spark, []), "one").count() == 0


def test_pii_is_a_permutation(spark):
    dates = spark.range(0, 4000).selectExpr("id as doc_id", "date_format(date_add(date'1990-01-01', cast(id as int)), 'yyyy-MM-dd') as text")
    ips = spark.range(0, 3000).selectExpr("id as doc_id", "concat('10.0.', id div 250, '.', id % 250) as text")
    for df, n in ((dates, 4000), (ips, 3000)):
        out = pii.pseudonymise(df, "one")
        assert out.select("text").distinct().count() == n and out.join(df, ["doc_id", "text"]).count() < 5


def test_pii_is_the_feistel_network(spark):
    """Addresses against a plain network with the same key."""

    def plain(value, left, right, name):
        a, b = divmod(value, right)
        for i in range(1, pii.ROUNDS + 1):
            prf = lambda half: int(hashlib.sha256(f"one/{name}/{i}/{left}/{half}".encode()).hexdigest()[:15], 16)
            a, b = ((a + prf(b) % left) % left, b) if i % 2 else (a, (b + prf(a) % right) % right)
        return a * right + b

    r = np.random.default_rng(8)
    rows = [(i, ".".join(map(str, r.integers(0, 256, 4)))) for i in range(200)] + [(500, "x " * 100_000 + "1.2.3.4")]
    with pytest.raises(ValueError):
        pii.pseudonymise(frame(spark, rows), "")
    for x in pii.pseudonymise(frame(spark, rows), "one").collect():
        old = dict(rows)[x["doc_id"]].split()[-1]
        n = plain(int.from_bytes(bytes(map(int, old.split("."))), "big"), 65536, 65536, "ip")
        assert x["text"].split()[-1] == ".".join(map(str, n.to_bytes(4, "big"))) and len(x["text"].split()) == len(dict(rows)[x["doc_id"]].split())


def test_pii_plan_has_no_python(spark):
    plan = pii.pseudonymise(frame(spark, EDGE), "one")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Decontamination


def test_decontaminate(spark):
    r = np.random.default_rng(7)
    items = [(i, words(r, int(r.integers(10, 60)), 3000)) for i in range(60)] + [(100, "too short"), (101, None)]
    rows, truth = [], {}
    for i, t in items[:60]:
        w = t.split()
        for share in (0.0, 0.1, 0.2):
            out = list(w)
            for _ in range(int(share * len(w))):
                p = int(r.integers(len(out)))
                if r.integers(2):
                    out[p] = "edit"
                else:
                    del out[p]
            doc = len(rows)
            rows.append((doc, words(r, int(r.integers(0, 90)), 3000) + " " + " ".join(out) + " " + words(r, int(r.integers(0, 90)), 3000)))
            truth[doc] = i
    clean = [(5000 + i, words(r, 200, 3000)) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {x["doc_id"]: x for x in decontaminate.contaminated(frame(spark, rows + clean + EDGE, "uid string, item_id int"), bench).collect()}
    hits = [truth[d] in found[d]["item_ids"] if d in found else False for d in truth]
    assert np.mean(hits) >= 0.97 and all(hits[::3]) and not any(d >= 5000 for d in found if d is not None)
    for d, x in found.items():
        for k, item in enumerate(x["item_ids"]):
            a, b = rows[d][1].lower().split()[x["first_words"][k] : x["end_words"][k]], dict(items)[item].lower().split()
            assert levenshtein(a, b) == x["distances"][k] <= 0.2 * len(b)
    kept = decontaminate.decontaminate(frame(spark, rows + clean + EDGE, "uid string, row int"), bench)
    assert kept.columns == ["doc_id", "text", "uid", "row"] and kept.count() == len(rows + clean + EDGE) - len(found)
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0 and decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 4, 5, 6, 7, 8, 9, 10, 12, 15, 17, 20, 25, 29, 30, 40])
def test_decontaminate_by_length(spark, n):
    """Items of each length, as they are and at the largest distance allowed, at any alignment."""
    r = np.random.default_rng(n)
    items = [(i, " ".join(f"a{x}" for x in r.integers(0, 10**9, n))) for i in range(100)]
    most = n // 5
    fill = lambda: [f"q{x}" for x in r.integers(0, 1000, int(r.integers(0, 40)))]
    rows = []
    for i, t in items:
        for edits in (0, most):
            w = t.split()
            for p in r.choice(n, edits, replace=False) if edits else []:
                w[int(p)] = "edit"
            rows.append((len(rows), " ".join(fill() + w + fill())))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]): x["distance"] for x in decontaminate.find_items(frame(spark, rows), bench).collect()}
    assert all(found.get((2 * i, i)) == 0 for i in range(100))
    hits = [found.get((2 * i + 1, i), 99) <= most for i in range(100)]
    assert np.mean(hits) >= 0.97 and (n >= 30 or all(hits))
    assert all(i == d // 2 for d, i in found)


def test_decontaminate_by_row(spark):
    """A row goes for its own text alone, whatever rows share its doc_id."""
    item = " ".join(f"i{k}" for k in range(20))
    rows = [(1, f"a b {item} c"), (1, "clean"), (None, item), (None, "clean too"), (2, None), (2, ""), (2, item), (2, item), (3, "z " * 60_000 + item)]
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    kept = Counter((x["doc_id"], x["text"]) for x in decontaminate.decontaminate(frame(spark, rows, "item_id string, uid int"), bench).collect())
    assert kept == Counter([(1, "clean"), (None, "clean too"), (2, None), (2, "")])
    found = {x["doc_id"]: x for x in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert set(found) == {1, 2, 3, None} and found[3]["first_words"] == [60_000]
    # Rows without an id are not gathered in one row.
    many = decontaminate.contaminated(frame(spark, [(None, f"{item} {k}") for k in range(9)] + [(None, f"{item} 0")]), bench).collect()
    assert [(x["doc_id"], x["item_ids"]) for x in many] == [(None, [5])] * 9


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


# Jaccard join


def brute_components(rows, n=4, link=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= link * (len(sets[i]) + len(sets[j]) - c):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))]


def near_copies():
    r = np.random.default_rng(9)
    rows = []
    for family in range(12):
        base = words(r, int(r.integers(3, 400)), 2000).split()
        for _ in range(8):
            w = list(base)
            for _ in range(int(r.integers(0, 1 + len(w) // 20))):
                w[int(r.integers(len(w)))] = f"e{r.integers(9999)}"
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    rows += [(2000 + k, " ".join(f"q{i}" for i in range(s, s + 120))) for k, s in enumerate(range(0, 60, 3))]  # a chain
    rows += [(3000 + k, " ".join(["a", "b", "c", "d", "e", "f", "g", "h", "i", "j"][: 3 + k])) for k in range(8)]
    return rows + EDGE + [(4000, rows[5][1]), (4000, rows[5][1])]


def test_jaccard(spark):
    rows = near_copies()
    got = jaccard.link_documents(frame(spark, rows, "node string, n int"))
    key = lambda x: repr(x)
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, brute_components(rows)))
    assert jaccard.link_documents(frame(spark, [])).count() == 0


def test_jaccard_without_slices(spark, monkeypatch):
    """Sets with too few slices that count go by single shingles, and the result is the same."""
    monkeypatch.setattr(jaccard, "regions", lambda h, link=85: (np.zeros(0, np.uint64), bool(len(h))))
    rows = [(i, t) for i, t in near_copies() if i is not None][:60]
    join = jaccard.Join(frame(spark, rows))
    monkeypatch.undo()
    all_ = join.all
    assert all_.count() == len(rows)
    odd = all_.withColumn("odd", all_["n"] > 0).withColumn("regions", all_["regions"].cast("array<long>"))
    join.all = odd
    assert sorted(map(repr, map(tuple, join.classes().collect()))) == sorted(map(repr, brute_components(rows)))


def test_regions_share(spark):
    """Any two sets that link enter a common region."""
    r = np.random.default_rng(11)
    for _ in range(400):
        n = int(r.integers(1, 700))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        gone = int(r.integers(0, len(a) * 15 // 100 + 1))
        b = np.unique(np.concatenate([a[gone:], r.integers(0, 1 << 62, int(r.integers(0, gone // 2 + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            (ra, oa), (rb, ob) = jaccard.regions(a), jaccard.regions(b)
            assert oa or ob or len(np.intersect1d(ra, rb))


def test_keep_one(spark):
    rows = near_copies()
    kept = jaccard.keep_one(frame(spark, rows, "_gone string, n int"))
    assert kept.columns == ["doc_id", "text", "_gone", "n"]
    # Unique ids tell the components; of each one row stays, the first by doc_id and text.
    own = [(i, t) for i, (_, t) in enumerate(rows)]
    groups = {}
    for i, n, c in brute_components(own):
        groups.setdefault((n == 0, c), []).append(rows[i])
    want = Counter(min(g, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")) for g in groups.values())
    assert Counter((x["doc_id"], x["text"]) for x in kept.collect()) == want


def test_keep_one_decides_by_row(spark):
    """One row of each component stays, and no row goes for sharing a doc_id, null or not, with a copy."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(1, a), (1, a), (None, a), (None, b), (None, ""), (None, None), (2, a + " tail"), (7, a), (7, c), (None, d), (None, d), (None, d)]
    kept = [(x["doc_id"], x["text"]) for x in jaccard.keep_one(frame(spark, rows)).collect()]
    assert Counter(kept) == Counter([(1, a), (None, b), (None, ""), (None, None), (7, c), (None, d)])
    assert jaccard.keep_one(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [3, 2000])
def test_cells_of_any_size(spark, monkeypatch, block):
    """Cells in blocks of few members give the same components, also where many strangers share a passage."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = np.random.default_rng(31)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = []
    for k in range(30):
        own = " ".join(f"o{k}x{i}" for i in range(40))
        for _ in range(3):
            w = f"{shared} {own}".split()
            w[int(r.integers(len(w)))] = f"e{r.integers(9999)}"
            rows.append((len(rows), " ".join(w)))
    got = jaccard.link_documents(frame(spark, rows))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_components(rows)))


def test_near_duplicates_of_the_pipeline(spark):
    """The stage against five words and 0.8, with pairs between that and the query's four words and 0.85."""
    import corpus_pipeline

    r = np.random.default_rng(21)
    rows = [(9000 + i, t) for i, (_, t) in enumerate(near_copies()) if t]
    for _ in range(20):
        base = [f"b{x}" for x in r.integers(0, 10**6, 1000)]
        edited = list(base)
        for p in r.choice(1000, 22, replace=False):
            edited[int(p)] = f"e{r.integers(10**6)}"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(edited))]
    want = sorted(d for d, n, c in brute_components(rows, 5, 80) if n == 0 or d == c)
    assert want != sorted(d for d, n, c in brute_components(rows) if n == 0 or d == c)
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()) == want


def test_regions_share_at_80():
    r = np.random.default_rng(12)
    met = 0
    for _ in range(600):
        n = int(r.integers(1, 1200))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        gone = int(r.integers(0, len(a) // 5 + 1))
        b = np.unique(np.concatenate([a[gone:], r.integers(0, 1 << 62, int(r.integers(0, gone // 2 + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            met += 1
            (ra, oa), (rb, ob) = jaccard.regions(a, 80), jaccard.regions(b, 80)
            assert oa or ob or len(np.intersect1d(ra, rb))
    assert met > 100


def test_template_family(spark, monkeypatch):
    """Texts of one template that don't link: regions recur, and few pairs are measured; links among them stay."""
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    r = np.random.default_rng(33)
    template = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(template + [f"o{i}x{k}" for k in range(100)])) for i in range(150)]
    for i in range(0, 150, 10):
        w = rows[i][1].split()
        w[int(r.integers(len(w)))] = "edit"
        rows.append((1000 + i, " ".join(w)))
    rows += [(3000, rows[0][1] + " tail"), (None, rows[3][1]), (4000, ""), (4001, None)]
    measured, compared = [], []
    old_measured, old_within = jaccard.Join.measured, jaccard.Join.within
    monkeypatch.setattr(jaccard.Join, "measured", lambda self, pairs, done=None: measured.append(out := old_measured(self, pairs, done)) or out)
    monkeypatch.setattr(jaccard.Join, "within", lambda self, placed, sizes: compared.append(sizes.selectExpr("coalesce(sum(size * strangers), 0)").first()[0]) or old_within(self, placed, sizes))
    got = jaccard.link_documents(frame(spark, rows))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_components(rows)))
    pairs = [(x["a"], x["b"]) for m in measured for x in m.select("a", "b").collect()]
    assert len(compared) >= 2 and len(pairs) == len(set(pairs))
    assert sum(compared) < 166 * 20
