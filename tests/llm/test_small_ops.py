"""URL filter, WARC derivatives, sharding, tool calls, decontamination, toxicity and the pipeline."""

import json
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from drawfield.llm import decontaminate, plans, sharding, toolcalls, toxicity, urls, warc
from drawfield.session import shared_dir


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(set(plans.oracle_sql()) - {"op1_topk_search"}))
def test_matches_sql(name, spark, sf_dir, duck):
    assert oracle.compare(plans.queries()[name](spark, sf_dir), duck, plans.oracle_sql()[name]) is None


# --- URL filter ------------------------------------------------------------------------

URLS = ["https://WWW.Example.com/en/x?q#f", "http://example.com/en/", "http://a.example.com/en/y", "https://x.net/es/1", "http://net/fr/",
        "http://com", "http://com/", "ftp://other.org/fr/2", None, "no scheme", "http://", "http://É.COM/Ä", "a://b://c/d", "http://notexample.com/en/",
        "http://h\nost.net/es/\nz?x", "http://x.org/" + "long/" * 2000, "http://exampleXcom/en/", "http://sub.x.net/es", "://net/es/"]


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def plain_buckets(host, path):
    out = []
    for mark, text in (("h:", host), ("p:", path)):
        letters = "^" + text + "$"
        out += [mark + letters[i:i + urls.GRAM] for i in range(len(letters) - urls.GRAM + 1)]
    hashed = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in out]
    return list(dict.fromkeys((h - (1 << 64) if h >> 63 else h) % urls.BUCKETS for h in hashed))


def test_url_filter_against_plain_python(spark):
    rows = [(i, u) for i, u in enumerate(URLS + URLS[:3])]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in urls.filter_urls(pages, urls.labelled_by_rules(pages)).collect()}
    labelled = [(plain_buckets(*plain_split(u)), float(plain_rule(*plain_split(u))[1] == "block"))
                for _, u in rows if u is not None and plain_rule(*plain_split(u))[1]]
    weights, bias, n = [0.0] * urls.BUCKETS, 0.0, len(labelled)
    spread = sum(len(b) for b, _ in labelled) / n
    for _ in range(urls.STEPS):
        miss = [1 / (1 + math.exp(-(bias + sum(weights[i] for i in b)))) - y for b, y in labelled]
        slope = {}
        for (b, _), m in zip(labelled, miss):
            for i in b:
                slope[i] = slope.get(i, 0) + m
        bias -= urls.RATE / spread * sum(miss) / n
        weights = [w - urls.RATE * (slope.get(i, 0) / n + urls.SHRINK * w) for i, w in enumerate(weights)]
    for i, u in rows:
        host, path = plain_split(u)
        rule, verdict = plain_rule(host, path)
        p = 1 / (1 + math.exp(-(bias + sum(weights[b] for b in plain_buckets(host, path)))))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert abs(got[i].block_probability - p) < 1e-6
        assert got[i].verdict == (verdict or ("block" if p > 0.5 else "allow"))


def test_url_filter_without_labels_and_rows(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string")
    none = urls.labelled_by_rules(pages)
    assert urls.filter_urls(pages, none).first().verdict == "allow"
    assert urls.filter_urls(pages.limit(0), none).count() == 0


def test_copies_of_a_url_leave_room_for_others(spark):
    """A bound of three different urls takes in all three, though each is there twelve times."""
    labelled = spark.createDataFrame([(f"http://{h}.org/x", b) for h, b in (("one", 1), ("two", 0), ("three", 1))] * 12, "url string, block int")
    bounded, whole = urls.train(labelled, steps=2, most=3), urls.train(labelled, steps=2)
    assert np.allclose(bounded[0], whole[0]) and abs(bounded[1] - whole[1]) < 1e-9


def test_url_model_learns(spark):
    """Held out: urls whose label it was not shown."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labelled = urls.labelled_by_rules(pages)
    shown = F.pmod(F.xxhash64("url"), F.lit(3)) > 0
    weights, bias = urls.train(labelled.filter(shown))
    host, path = urls.split_url(F.col("url"))
    held = labelled.filter(~shown).withColumn("p", urls.probability(urls.buckets(host, path), weights, bias))
    right = held.agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("block")).cast("double"))).first()[0]
    assert right > 0.85


# --- WARC ------------------------------------------------------------------------------

def test_warc_files_parse(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>Caf&eacute; &amp;amp; <b>x</b>\n\n y</p><script>no</script><!-- <p>no</p> -->z"), (2, None, None),
                                   (3, "http://b/", ""), (3, "http://b/", ""), (4, "u", "<STYLE\n>x</style >" + "<div>a</div>" * 9000)],
                                  "page_id long, url string, html string")
    records = warc.derive(warc.responses(pages))
    warc.write_warc(records, str(tmp_path / "w"))
    found = []
    for file in (tmp_path / "w").glob("part-*"):
        raw = file.read_bytes()
        while raw:
            head, raw = raw.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            n = int(fields["Content-Length"])
            block, raw = raw[:n], raw[n:]
            assert raw[:4] == b"\r\n\r\n"
            raw = raw[4:]
            found.append((fields, block.decode()))
    rows = records.collect()
    assert len(found) == len(rows) == 10
    ids = {r.refers_to for r in warc.responses(pages).select(F.col("record_id").alias("refers_to")).collect()}
    import hashlib
    for fields, block in found:
        assert fields["WARC-Refers-To"] in ids
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block.encode()).hexdigest()
    text = {r.page_id: r.block for r in rows if r.record_type == "conversion"}
    assert text[1] == "Caf&eacute; &amp; x\ny\nz" and text[2] == text[3] == "" and text[4] == "\n".join("a" * 9000)
    about = [r for r in rows if r.record_type == "metadata" and r.page_id == 1][0]
    assert about.payload_digest in about.block and "HTTP/1.1 200 OK" in about.block


# --- sharding --------------------------------------------------------------------------

def test_sharding_laws(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.op5_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    loads = [0] * 16
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        loads[r.shard] += r["size"]
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 16
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_sharding_odd_rows_and_map_versions(spark):
    rows = [(None, None), (None, "x"), (3, ""), (3, ""), (3, "é"), (4, "y" * 40000)] + [(i, "z" * i) for i in range(200)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    out, maps = sharding.shard(docs, shards=4, slots=64)
    got = out.collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    first = {r.virtual_slot: r.shard for r in maps.filter("version = 1").collect()}
    second = {r.virtual_slot: r.shard for r in maps.filter("version = 2").collect()}
    assert first == {s: s % 4 for s in range(64)} and set(second) == set(first)
    assert all(second[r.virtual_slot] == r.shard for r in got)
    assert sharding.shard(docs.limit(0), 4, 64)[0].count() == 0


def test_version_three_edits_version_two(spark):
    small = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 40).cast("int")).alias("text"))
    path = f"{shared_dir(spark, 'maps')}/map"
    sharding.save_map(sharding.shard(small, 4, 64)[1], path)
    second = sharding.load_map(spark, path)
    assert second.first()["version"] == 2 and sharding.load_map(spark, path, 1).count() == 64
    # a third of all rows share one slot, and the table has doubled
    hot = spark.range(150).select(F.lit(7).cast("long").alias("doc_id"), F.lit("hot text").alias("text"))
    grown = small.unionByName(hot).unionByName(spark.range(1000, 1200).select(F.col("id").alias("doc_id"), F.lit("new").alias("text")))
    with pytest.raises(ValueError, match="other rows"):
        sharding.shard_by(grown, second)
    third, edits = sharding.edit_map(second, grown)
    sharding.save_map(third, path)
    third = sharding.load_map(spark, path)
    old, new = ({r.virtual_slot: r.shard for r in m.collect()} for m in (second, third))
    assert third.first()["version"] == 3
    assert {(s, old[s], new[s]) for s in old if old[s] != new[s]} == set(edits)
    got = sharding.shard_by(grown, third).collect()
    assert len(got) == 650 and all(new[r.virtual_slot] == r["shard"] for r in got)
    for s in range(4):
        assert sorted(r.place for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    # a fifth shard takes slots, none moves between the old ones but to even out
    wider, edits = sharding.edit_map(third, grown, shards=5)
    assert edits and {r.shard for r in wider.collect()} == set(range(5))
    with pytest.raises(ValueError, match="beyond 3"):
        sharding.edit_map(third, grown, shards=3)
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.save_map(third, path)
    with pytest.raises(ValueError, match="version 9"):
        sharding.load_map(spark, path, 9)
    nothing, edits = sharding.edit_map(third, grown.limit(0))
    assert not edits and nothing.agg({"slot_rows": "sum"}).first()[0] == 0


def test_rebalancing_moves_few_slots():
    rng = random.Random(3)
    weight = [rng.randrange(100, 200) for _ in range(640)]
    owner = [s % 8 for s in range(640)]
    edits = sharding.rebalance(owner, weight, 8)
    now = list(owner)
    for slot, a, b in edits:
        assert owner[slot] == a != b
        now[slot] = b
    loads = [sum(w for w, o in zip(weight, now) if o == s) for s in range(8)]
    assert max(loads) - min(loads) <= 2 and len(edits) < 120
    assert sharding.rebalance([0, 1], [0, 0], 2) == []


# --- tool calls ------------------------------------------------------------------------

def test_tool_calls(spark):
    calls = spark.createDataFrame([
        ("a", 1, 0, "search", '{"query":"q", "limit": 3}', None), ("b", 1, 2, "lookup", '{"key":"k"}', "a"), ("c", 1, 4, "lookup", '{"key":"k"}', "b"),
        ("c", 1, 4, "lookup", '{"key":"k"}', "b"), ("d", 2, 0, "nope", '{"z":1,"a":[1, {"y":2,"b":3}]}', "gone"), ("e", 2, 1, None, None, None),
        ("f", 2, 2, "search", '[1]', None), ("g", 2, 3, "search", '{"limit":"x","query":1,"more":null}', None), ("h", 3, 0, "lookup", '{"key":"k"}', "i"),
        ("i", 3, 1, "lookup", '{"key":"k"}', "h"), ("j", 3, 2, "lookup", '{"key":"k"}', "i"), (None, 3, 3, "lookup", "{", None), ("k", 4, 0, "lookup", "{broken", "k")],
        "call_id string, conv_id int, turn int, name string, arguments string, parent_id string").withColumn("status", F.lit("clash"))
    results = spark.createDataFrame([("a", "a\n\"x\""), ("a", "zz"), ("b", None), ("lost", "r"), (None, "n")], "call_id string, content string")
    got = {r.call_id: r for r in toolcalls.link(calls, results).collect()}
    assert set(got) == set("abcdefghijk") | {"lost"}
    assert {k: r.topo_level for k, r in got.items()} == dict(a=0, b=1, c=2, d=0, e=0, f=0, g=0, h=None, i=None, j=None, k=None, lost=None)
    assert {k: r.status for k, r in got.items()} == dict(a="linked", b="linked", c="unanswered", d="invalid", e="invalid", f="invalid", g="invalid",
                                                        h="cycle", i="cycle", j="cycle", k="cycle", lost="orphan_result")
    assert got["d"].errors == ["unknown tool"] and got["e"].errors == ["unknown tool", "not an object"] and "not an object" in got["f"].errors
    assert got["g"].errors == ["type of limit", "type of query", "unexpected more"]
    assert got["a"].canonical == '{"arguments":{"limit":3,"query":"q"},"id":"a","name":"search","parent":null,"result":"a\\n\\"x\\""}'
    for r in got.values():
        assert json.dumps(json.loads(r.canonical), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.canonical
    assert toolcalls.link(calls.limit(0), results.limit(0)).count() == 0


def test_whole_numbers_and_broken_arguments(spark):
    texts = {"a": '{"limit":1.0,"query":"q"}', "b": '{"limit":1.5,"query":"q"}', "c": '{"limit":1,"limit":2,"query":"q"}',
             "d": '{"limit":', "e": None, "f": '{"limit":-20.00,"query":"q"}', "g": '{"limit":"1","query":"q"}'}
    calls = spark.createDataFrame([(i, 1, 0, "search", t, None) for i, t in texts.items()],
                                  "call_id string, conv_id long, turn int, name string, arguments string, parent_id string")
    results = spark.createDataFrame([(i, "r") for i in texts], "call_id string, content string")
    got = {r.call_id: r for r in toolcalls.link_all(calls, results).collect()}
    assert {i for i, r in got.items() if r.status == "linked"} == {"a", "f"}
    assert got["b"].errors == got["g"].errors == ["type of limit"]
    canonical = {i: json.loads(r.canonical) for i, r in got.items()}
    assert canonical["a"]["arguments"] == {"limit": 1, "query": "q"} and "raw" not in canonical["a"]
    assert canonical["c"]["raw"] == texts["c"] and canonical["d"]["raw"] == texts["d"]
    assert canonical["e"]["arguments"] is None and "raw" not in canonical["e"]


def test_every_call_and_result_keeps_a_row(spark):
    """Ids of their conversation only, repeated and null ones."""
    key = '{"key":"k"}'
    calls = spark.createDataFrame(
        [("call_1", c, 0, "lookup", key, None) for c in (1, 2, 3)] + [("call_2", c, 2, "lookup", key, "call_1") for c in (1, 2)]
        + [("call_1", 1, 0, "lookup", key, None), ("call_1", 1, 4, "lookup", key, None), (None, 1, 6, "lookup", key, None),
           ("call_1", None, 0, "lookup", key, None), ("call_9", 3, 8, "lookup", key, "call_2")],
        "call_id string, conv_id int, turn int, name string, arguments string, parent_id string")
    results = spark.createDataFrame([("call_1", 1, "r1"), ("call_1", 2, "r2"), ("call_1", 2, "s2"), ("call_2", 3, "lost"), (None, 1, "n")],
                                    "call_id string, conv_id int, content string")
    got = toolcalls.link_all(calls, results).collect()
    text = {(r.conv_id, r.turn, r.status): json.loads(r.canonical)["result"] for r in got}
    want = {(1, 0, "linked"): "r1", (2, 0, "linked"): "r2", (3, 0, "unanswered"): None, (1, 2, "unanswered"): None, (2, 2, "unanswered"): None,
            (1, 0, "duplicate_call"): None, (1, 4, "duplicate_call"): None, (1, 6, "no_id"): None, (None, 0, "no_id"): None, (3, 8, "unanswered"): None,
            (None, None, "duplicate_result"): "s2", (None, None, "orphan_result"): "lost", (None, None, "no_id"): "n"}
    assert text == want and len(got) == len(want)
    assert {(r.conv_id, r.turn): r.topo_level for r in got if r.status in ("linked", "unanswered")} == {
        (1, 0): 0, (2, 0): 0, (3, 0): 0, (1, 2): 1, (2, 2): 1, (3, 8): 0}
    assert toolcalls.link(calls, results).count() == 7


def test_turns_without_conversation_stay_apart(spark):
    turns = [(None, 0, "user", "a"), (None, 0, "user", "b"), (None, 1, "assistant", "c"), (1, 0, "user", "d"), (1, 0, "user", "e"), (1, 1, "assistant", "f")]
    talk = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    got = sorted(r.status for r in toolcalls.link_all(*toolcalls.calls_in(talk)).collect())
    assert got == ["duplicate_call", "linked", "no_id", "no_id", "no_id"]


def test_long_chains_take_few_rounds(spark):
    n = 300
    calls = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(n)], "call_id string, parent_id string")
    got = {r.call_id: r.topo_level for r in toolcalls.levels(calls).collect()}
    assert got == {f"c{i}": i for i in range(n)}


# --- decontamination -------------------------------------------------------------------

def plain_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[-1] - 1))
        row = new
        best = max(best, max(row))
    return best


def test_alignment_against_plain_loops():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 30))
        score, first, last = decontaminate.align(a, b)
        assert score == plain_alignment(a.tolist(), b.tolist())
        if score:
            assert plain_alignment(a.tolist(), b[first:last].tolist()) == score


def leak_table(rng):
    words = [f"v{i}" for i in range(400)]
    common = ["the", "of", "and"]
    items = [(i, " ".join(rng.choices(words, k=24))) for i in range(12)] + [(12, None), (13, " ?! "), (14, "Solo"), (15, "the of and the of"), (3, None)]
    filler = lambda n: rng.choices(words + common * 150, k=n)
    docs, want = [], {}
    for i in range(40):
        body, kind = filler(60), i % 4
        item = items[i % 12][1].split()
        if kind == 0:
            body[30:30] = item
        elif kind == 1:
            edited = list(item)
            edited[5], edited[13] = "changed", "edits"
            del edited[18]
            body[10:10] = ["X"] + [w.upper() + "," for w in edited]
        elif kind == 2:
            body[20:20] = item[:5]
        if kind < 2:
            want[i] = i % 12
        docs.append((i, rng.choice([" ", "\n", " - "]).join(body)))
    docs += [(40, None), (41, ""), (42, items[0][1] * 1), (42, items[0][1]), (None, items[1][1])]
    return docs, items, want


def test_leaks_are_found_and_clean_documents_left(spark):
    docs, items, want = leak_table(random.Random(9))
    got = decontaminate.leaks(spark.createDataFrame([(i, t, 2.0) for i, t in docs], "doc_id long, text string, score double"),
                              spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id): r for r in got}
    assert {(d, i) for d, i in pairs if d is not None and d < 40 and i < 12} == set(want.items())
    assert (42, 0) in pairs and (None, 1) in pairs and sum(r.doc_id == 42 for r in got) == 2
    for (d, i), r in pairs.items():
        if d is not None and d < 40 and i < 12:
            words = re.findall("[0-9a-z]+", dict(docs)[d].lower())
            whole = plain_alignment(dict(items[:12])[i].split(), words)
            assert abs(r.score - whole / 48) < 1e-9


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    docs, items, _ = leak_table(random.Random(9))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.leaks(d, b).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    assert sorted(map(str, decontaminate.leaks(d, b).collect())) == whole
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


# --- toxicity --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def toxic_table(spark):
    rng = random.Random(4)
    words, bad = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["idiotic", "scummy", "trashy", "vile"]
    rows = []
    for i in range(600):
        body = rng.choices(words, k=60)
        toxic, low = i % 7 == 0, i % 5 == 1
        if toxic:
            body[5:5] = rng.sample(bad, 2)
        if low:
            body += ["spammish"] * 3
        rows.append((i, " ".join(body), int(toxic), int(not low)))
    docs = spark.createDataFrame([(i, t, "l") for i, t, _, _ in rows] + [(1000, None, "l"), (1001, "", None), (None, "vile scummy trashy", "l")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, x) for i, _, x, q in rows if i < 400] + [(3, 1, 0), (None, 1, 1), (9999, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: x for i, _, x, _ in rows}


def test_held_out_documents(toxic_table):
    docs, labels, toxic = toxic_table
    scored = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(scored) == 603
    held = [i for i in range(400, 600)]
    right = sum((scored[i].toxic_probability >= toxicity.THRESHOLD) == bool(toxic[i]) for i in held)
    assert right / len(held) > 0.97
    assert scored[1000].toxic_probability < toxicity.THRESHOLD and scored[None].toxic_probability > toxicity.THRESHOLD
    assert scored[None].lang == "l"


def test_chain_uses_out_of_fold_probabilities():
    """Later models see the earlier probabilities; a row's own label never enters its probability."""
    rng = np.random.default_rng(2)
    n, d = 120, 10
    x = rng.random((n, d)) < 0.3
    rows, columns = np.nonzero(x)
    y = np.column_stack([x[:, 0], x[:, 0] & x[:, 1], x[:, 2]]).astype(float)
    models, oof = toxicity.fit_chain(rows, columns, n, d, y)
    assert [len(m.v) for m in models] == [0, 1, 2] and oof.shape == (n, 3)
    changed = y.copy()
    changed[6, 0] = 1 - changed[6, 0]
    assert abs(toxicity.fit_chain(rows, columns, n, d, changed)[1][6, 0] - oof[6, 0]) < 1e-12


def test_without_labels_nothing_is_toxic(spark, toxic_table):
    docs, labels, _ = toxic_table
    scored = toxicity.score(docs, toxicity.train(docs, labels.limit(0)))
    assert scored.filter(F.col("toxic_probability") >= toxicity.THRESHOLD).count() == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


# --- pipeline --------------------------------------------------------------------------

def test_pipeline_stages(spark, sf_dir):
    """Each stage against brute force on what the one before kept."""
    from test_jaccard import brute
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    clean = corpus_pipeline.stored(corpus_pipeline.drop_toxic(spark, docs, sf_dir), "test")
    assert clean.schema == docs.schema
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    kept = {r.doc_id for r in scored.filter(F.col("toxic_probability") < toxicity.THRESHOLD).collect()}
    assert {r.doc_id for r in clean.collect()} == kept
    single = corpus_pipeline.stored(corpus_pipeline.drop_near_copies(spark, clean, sf_dir), "test")
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert {r.doc_id for r in single.collect()} == {d for d, _, c in brute(rows, 5, 80) if d == c}
    fresh = corpus_pipeline.stored(corpus_pipeline.drop_contaminated(spark, single, sf_dir), "test")
    assert fresh.schema == docs.schema
    tests = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in fresh.collect()}
    for r in single.collect():
        words = re.findall(r"[^\W_]+", r.text.lower())
        exact = any(" ".join(t) in " ".join(words) for t in tests)
        assert not (exact and r.doc_id in left)
        if r.doc_id not in left:
            assert max(plain_alignment(t, words) / (2 * len(t)) for t in tests) >= decontaminate.SCORE
    packed = corpus_pipeline.pack(spark, fresh, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left)


def test_near_copies_leave_one_row_of_each_group(spark):
    """Repeated rows, null ids, and an id that stands for two texts."""
    def text(x):
        return " ".join(f"{x}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("a")), (2, text("a") + " more"), (2, text("b")), (None, text("a")), (None, text("c")), (None, text("c")),
            (5, ""), (5, ""), (6, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "l") for i, t in rows], "doc_id long, text string, lang string")
    kept = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect()]
    want = [(1, text("a")), (2, text("b")), (None, text("c")), (5, ""), (6, None), (None, ""), (None, "")]
    assert sorted(kept, key=str) == sorted([(i, t, "l") for i, t in want], key=str)
