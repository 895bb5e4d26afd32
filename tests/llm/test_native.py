"""Quality rules, chat formatting, URL verdicts and shards on small fixtures."""

from __future__ import annotations

import re
import zlib

import pytest
from pyspark.sql import functions as F

from chartloom.llm import chat, hosts, kdtree, quality
from chartloom.llm.queries import QUERIES
from chartloom.llm.queries_native import RULES

PROSE = "This sentence has a few plain words, and it ends as sentences do."


def repeated(words, size=8):
    windows = {}
    for i in range(len(words) - size + 1):
        windows.setdefault(tuple(words[i : i + size]), []).append(i)
    return len({p + k for starts in windows.values() if len(starts) > 1 for p in starts for k in range(size)})


def judged(spark, texts):
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    df = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    return [r["quality"] for r in df.orderBy("doc_id").collect()]


def test_quality_counts(spark):
    texts = [None, "", " \n\t", "a b c d e f g h a b c d e f g h x", "w " * 5000, "one\n\none\r\none\nOne", "é # ü * |\x0b<", (PROSE + " ") * 400 + "end."]
    for text, got in zip(texts, judged(spark, texts), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert got["n_words"] == len(words)
        assert got["word_chars"] == sum(map(len, words))
        assert got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert got["n_dup_lines"] == len(lines) - len(set(lines))
        assert got["n_repeat_words"] == repeated(words)
        assert got["base_failed"] == (len(words) < 20 or 100 * repeated(words) > 30 * len(words))


def test_quality_verdicts(spark):
    body = "\n".join(f"Line {'abcdefghij'[i]} says something of its own, with {'klmnopqrst'[i]} in it." for i in range(6))
    good = [body, body + "\nAll rights reserved.\nHome | News | About us", body.replace("Line", "L1"), "Zeile eins über Äpfel, und so weiter. " + body]
    bad = [
        " | ".join(f"link{chr(97 + i)}" for i in range(25)),
        " ".join(f"word{chr(97 + i)}{'%%%'}" for i in range(25)),
        " ".join(f"LOUD{chr(65 + i)}!!" for i in range(25)),
        " ".join(f"nomark{chr(97 + i)}" for i in range(25)),
    ]
    assert [r["kept"] for r in judged(spark, good + bad)] == [True] * 4 + [False] * 4
    assert judged(spark, good)[1]["clean_text"] == body


def test_quality_of_no_rows(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chat(spark):
    def conv(i, *texts):
        return [(i, k * 3, "user" if k % 2 == 0 else "assistant", t, "x") for k, t in enumerate(texts)]

    rows = conv(1, "a") + conv(2, "a", "b") + conv(3, "a", "b", "c") + conv(4, "a", "b", "c") + conv(5, "a", "x") + conv(6, None) + conv(7, "")
    rows += conv(8, *[f"t{i}" for i in range(700)]) + conv(9, *[f"t{i}" for i in range(300)]) + conv(None, "n", "m")
    rows += [(10, None, "user", "first", "x"), (10, 1, "user", "second", "x"), (10, 1, None, "again", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = chat.format_chats(df).collect()
    kept = {r["conv_id"]: (r["n_turns"], r["n_copies"]) for r in got}
    assert kept == {3: (3, 2), 5: (2, 1), 6: (1, 1), 7: (1, 1), 8: (700, 1), None: (2, 1), 10: (3, 1)}
    text = {}
    for r in sorted(got, key=lambda r: r["part"]):
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["text"]
    assert text[3] == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\nc\n<|end|>\n"
    assert text[8] == "".join(f"<|{'user' if i % 2 == 0 else 'assistant'}|>\nt{i}\n<|end|>\n" for i in range(700))
    assert text[10].startswith("<|user|>\nfirst") and text[10].count("<|end|>") == 3
    assert sorted(r["part"] for r in got if r["conv_id"] == 8) == [0, 1, 2]
    assert chat.format_chats(df.limit(0)).count() == 0


URLS = [
    (1, "https://A.Example.ORG/es/x?q#f", "org", "block"),
    (2, "http://example.org/en/123", "org", "block"),
    (3, "http://example.org/en/2", "org", "allow"),
    (4, "http://notexample.org/es/1", "org", "allow"),
    (5, "http://x.com/de/1", "com", "block"),
    (6, "http://x.com/fr/1", "com", "allow"),
    (7, "no address", "", "allow"),
    (8, None, "", "allow"),
    (9, "http://x.org", "none", "allow"),
    (10, "http://clean.net/?a://b/c", "none", "allow"),
]


def test_rules_and_parts_of_urls(spark):
    df = spark.createDataFrame([(i, u, "<p>", "c") for i, u, _, _ in URLS], "page_id long, url string, html string, judged string")
    got = {r["page_id"]: r["judged"] for r in hosts.judge_urls(df, RULES).collect()}
    assert {i: got[i]["verdict"] for i in got} == {i: v for i, _, _, v in URLS}
    assert [got[1][c] for c in ("host", "path", "rule")] == ["a.example.org", "/es/x", "example.org/es/"]
    assert [got[2]["rule"], got[4]["rule"], got[9]["rule"]] == ["example.org/en/1", "org/", None]
    assert [got[10]["host"], got[10]["path"]] == ["clean.net", "/"]
    assert hosts.judge_urls(df.limit(0), RULES).count() == 0


def brute_flow(edges, seeds, rounds=hosts.ROUNDS, damping=hosts.DAMPING):
    total = {}
    for a, _, w in edges:
        total[a] = total.get(a, 0) + w
    score = {h: s * (1 - damping) for h, s in seeds.items()}
    base = dict(score)
    for _ in range(rounds):
        new = dict(base)
        for a, b, w in edges:
            if a in score:
                new[b] = new.get(b, 0) + score[a] * w / total[a] * damping
        score = new
    return score


def test_propagation(spark):
    def link(*to):
        return "".join(f'<a class=x href="{t}">t</a>' for t in to)

    pages = [
        (1, "http://good.org/a", link("http://friend.net/1", "//FRIEND.net/2", "http://good.org/b")),
        (2, "http://friend.net/x", link("http://other.net/")),
        (3, "http://farm.net/x", link("https://x.com/de/1", "http://friend.net/")),
        (4, "http://x.com/de/1", link("http://good.org/")),
        (5, "http://far.net/x", link("http://farm.net/")),
        (6, "http://other.net/x", None),
        (7, "http://farm.net/y", link("http://x.com/")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["judged"] for r in hosts.judge_urls(df, RULES).collect()}
    edges = [("good.org", "friend.net", 1), ("friend.net", "other.net", 1), ("farm.net", "x.com", 2), ("farm.net", "friend.net", 1),
             ("x.com", "good.org", 1), ("far.net", "farm.net", 1)]
    trust = brute_flow(edges, {"good.org": 1.0})
    distrust = brute_flow([(b, a, w) for a, b, w in edges], {"x.com": 1.0})
    for r in got.values():
        assert r["trust"] == pytest.approx(trust.get(r["host"], 0), abs=1e-8)
        assert r["distrust"] == pytest.approx(distrust.get(r["host"], 0), abs=1e-8)
    assert {i: got[i]["verdict"] for i in got} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "block"}


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_near_equal(spark, hot):
    rows = [(i, None if i % 50 == 0 else ("same text " * 5 if hot and i % 3 == 0 else f"text {i} " * (i % 40)), "l" if hot else f"l{i % 5}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("slot", F.lit("clash"))
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    got = kdtree.kd_shards(df, ["lang", "doc_id"], size, n_shards=7, keep=["doc_id"]).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(2000))
    total, most = {}, 0
    slots = {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        most = max(most, r["size"])
    assert sorted(total) == list(range(7))
    assert max(total.values()) - min(total.values()) <= 3 * most + sum(total.values()) / 200
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_equal_rows_and_none(spark):
    df = spark.createDataFrame([(1, "x")] * 40, "doc_id long, text string")
    got = kdtree.kd_shards(df, ["doc_id"], F.lit(2), target_bytes=20, keep=["doc_id"]).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [10] * 4
    assert kdtree.kd_shards(df.limit(0), ["doc_id", "text"], F.lit(2), n_shards=3, keep=["doc_id"]).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 8, "doc_id long, text string")
    got = kdtree.kd_shards(nulls, ["doc_id", "text"], F.lit(1), n_shards=2, keep=["doc_id"]).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [4, 4]


def test_shard_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op10_sharding"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    total = [0] * 8
    for r in got:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        total[r["shard"]] += r["size"]
    assert max(total) - min(total) <= 2 * max(r["size"] for r in got)


def test_quality_in_other_scripts(spark):
    hindi = "यह एक साधारण वाक्य है जिसमें कई शब्द हैं और यह दंड से समाप्त होता है। दूसरा वाक्य भी वैसा ही साधारण है।"
    arabic = "هذه جملة عادية فيها كلمات كثيرة تكفي لكي تكون طويلة، ثم تأتي جملة أخرى بعدها كما هو معتاد في النصوص الطويلة"
    german = "Alle Rechte vorbehalten durch den Verlag und seine Partner im Inland und im Ausland."
    plain = "Der Brief kam am Morgen, und alle lasen ihn mit Freude am runden Tisch im Garten."
    got = judged(spark, [f"{hindi}\n{hindi[:-1]} फिर।", f"{arabic}\n{arabic} أيضا", f"{plain}\n{german}", f"{plain}\nTous droits réservés, 2020\n{plain} Oui."])
    assert [r["n_removed_lines"] for r in got] == [0, 0, 1, 1]
    assert got[0]["lost_chars"] == got[1]["lost_chars"] == 0
