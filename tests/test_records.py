import json

from pyspark.sql import functions as F

from grainmill.operators import clean, decontaminate, dedup, documents, filters, generate, quality, stats, templates
from grainmill.operators import vocabulary as V
from grainmill.operators.convert import classify, convert, detect
from grainmill.schema import MESSAGES, examples
from grainmill.sources import readers
from grainmill.sources.export import Export, bundle, rows, slug, supported


def records(spark, *own):
    """Records of dicts; lists of messages as (role, content) or dicts."""
    fields = ["messages", "chosen", "rejected", "completion"]
    out = []
    for i, r in enumerate(own):
        r = {"id": f"r{i}", "seq": i, **r}
        for f in fields:
            if f in r:
                r[f] = [m if isinstance(m, dict) else {"role": m[0], "content": m[1]} for m in r[f]]
        out.append(json.dumps(r))
    df = spark.createDataFrame([(x,) for x in out], "j string")
    schema = f"id string, seq bigint, type string, label boolean, answer string, split string, tags array<string>, quality_score int, created_at bigint, tools array<struct<name:string,description:string,parameters:string>>, {', '.join(f'{f} {MESSAGES}' for f in fields)}"
    return examples(df.select(F.from_json("j", schema).alias("r")).select("r.*"))


def found(spark, record, target=None):
    return [(i.type, i.severity) for i in quality.analyze(records(spark, record), target).first().issues]


def test_message_issues(spark):
    good = ("assistant", "a perfectly fine reply")
    ask = ("user", "a perfectly fine question")
    assert found(spark, {"messages": [ask, good]}) == []
    assert found(spark, {"messages": []}) == [("empty_field", "critical"), ("missing_role", "high"), ("missing_role", "high")]
    assert ("invalid_role", "high") in found(spark, {"messages": [ask, ("robot", "some text here"), good]})
    assert [x for x in found(spark, {"messages": [ask, ("assistant", "")]}) if x[0] in ("empty_field", "too_short")] == [("empty_field", "critical"), ("too_short", "medium")]
    assert ("refusal_pattern", "high") in found(spark, {"messages": [ask, ("assistant", "I'm sorry, but I can't do that.")]})
    assert ("pii_detected", "high") in found(spark, {"messages": [("user", "write to a@b.org please"), good]})
    assert ("special_token_conflict", "medium") in found(spark, {"messages": [("user", "what is <|im_end|> here"), good]})
    assert ("special_token_conflict", "high") in found(spark, {"messages": [("user", "what is <|im_end|> here"), good]}, {"name": "m", "family": "chatml", "seq_len": 99})
    assert ("context_overflow", "critical") in found(spark, {"messages": [ask, good]}, {"name": "m", "family": "chatml", "seq_len": 3})
    assert found(spark, {"messages": [good, ask]}) == [("incoherent_turn_order", "medium")]
    assert ("incoherent_turn_order", "medium") in found(spark, {"messages": [ask, ask, good]})


def test_tool_results_need_an_earlier_call(spark):
    call = {"role": "assistant", "content": "let me look that up", "tool_calls": [{"id": "c1", "name": "f", "arguments": "{oops"}]}
    result = {"role": "tool", "content": "forty two", "tool_call_id": "c1"}
    ask = ("user", "a perfectly fine question")
    assert [x[0] for x in found(spark, {"messages": [ask, call, result]})] == ["malformed_tool_call"]
    assert "orphan_tool_result" in [x[0] for x in found(spark, {"messages": [ask, result, call]})]


def test_types_have_their_own_requirements(spark):
    ask = ("user", "a perfectly fine question")
    assert ("empty_field", "critical") in found(spark, {"type": "preference", "messages": [ask], "chosen": [("assistant", "a fine reply")]})
    assert ("empty_field", "critical") in found(spark, {"type": "kto", "messages": [ask], "completion": [("assistant", "a fine reply")]})
    assert found(spark, {"type": "rl", "messages": [ask], "answer": "42"}) == []


def test_only_later_copies_are_duplicates(spark):
    one = {"messages": [("user", "A  question\nhere"), ("assistant", "an answer there")]}
    two = {"messages": [("user", "a question here"), ("assistant", "An answer THERE")]}
    got = {r.id: [i.type for i in r.issues] for r in quality.analyze(records(spark, one, two)).collect()}
    assert got == {"r0": [], "r1": ["duplicate"]}


def test_cleaning(spark):
    dirty = {"messages": [("human", "mail a@b.org  \n\n\n\nitâ\u0080\u0099s\x00 "), ("assistant", " "), ("gpt", "As an AI model I refuse. Fine.")], "rejected": [("assistant", "as an ai language model. No.")]}
    row = clean.clean(records(spark, dirty), clean.Cleaning(remove_refusals=True)).first()
    assert [(m.role, m.content) for m in row.messages] == [("user", "mail [EMAIL]\n\nit's"), ("assistant", "Fine.")]
    assert row.rejected[0].content == "as an ai language model. No." and row.changed


def test_exact_and_near_duplicates(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:30], "x", "y", *words[32:]]
    df = records(spark, *({"messages": [("user", t)]} for t in (" ".join(words), " ".join(near), " ".join(words).upper(), "something else altogether", "")))
    assert [(r.keep_id, r.n) for r in dedup.exact_groups(df).collect()] == [("r0", 2)]
    pairs = dedup.exact_pairs(df, 0.8).collect()
    assert [(p.a, p.b) for p in pairs] == [("r0", "r1")] and abs(pairs[0].similarity - 54 / 62) < 1e-9
    groups = {r.id: r.keep_id for r in dedup.near_groups(df, 0.8).collect()}
    assert groups == {"r0": "r0", "r1": "r0", "r2": "r0"}
    assert sorted(r.id for r in dedup.without(df, dedup.find_duplicates(df, 0.8)).collect()) == ["r0", "r3", "r4"]


def test_exact_pairs_equal_brute_force(spark, tmp_path):
    import random

    r = random.Random(8)
    texts, vocabulary = [], [f"w{k}" for k in range(400)]
    for _ in range(60):
        t = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 12, 40, 200]))]
        texts.append(t)
        for _ in range(r.randint(0, 4)):
            copy = list(r.choice(texts))
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(copy)
    df = records(spark, *({"messages": [("user", ",  ".join(t).upper())]} for t in [*texts, []]))
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(frozenset(tuple(t[i : i + 3]) for i in range(max(1, len(t) - 2))), f"r{k}")
    for threshold in (0.5, 0.8, 0.855, 1.0):
        want = {(min(a, b), max(a, b)): len(x & y) / len(x | y) for x, a in first.items() for y, b in first.items() if a < b and len(x & y) / len(x | y) >= threshold}
        got = {(p.a, p.b): p.similarity for p in dedup.exact_pairs(df, threshold, prefix=None).collect()}
        assert len(got) == len(want), (sorted(got.keys() - want.keys()), sorted(want.keys() - got.keys()))
        assert got == want and (len(want) > 10 or threshold > 0.5)


def test_exact_pairs_write_about_their_input(spark, tmp_path, monkeypatch):
    import random

    r = random.Random(9)
    texts = [" ".join(f"{r.getrandbits(40):x}" for _ in range(400)) for _ in range(300)]
    texts += [t + " end" for t in texts]
    monkeypatch.setattr(dedup, "stored", lambda df, n=iter(range(100)): (df.write.parquet(p := str(tmp_path / str(next(n)))), spark.read.parquet(p))[1])
    assert dedup.exact_pairs(records(spark, *({"messages": [("user", t)]} for t in texts)), prefix=None).count() == 300
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if f.is_file()) < 3 * sum(map(len, texts))


def test_near_duplicates_of_whole_texts(spark, tmp_path):
    from grainmill.plans import queries

    head = " ".join(f"head{i}" for i in range(400))
    bodies = [" ".join(f"{k}x{i}" for i in range(2000)) for k in "ab"]
    texts = [f"{head} {bodies[0]}", f"{head} {bodies[1]}", "other words here " + head.replace("head", "h") + " " + " ".join(f"c{i}" for i in range(5000)), " ".join(f"c{i}" for i in range(5000))]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.id: r.keep_id for r in queries.near_dup_groups(spark, str(tmp_path)).collect()} == {"2": "2", "3": "2"}
    df = records(spark, *({"messages": [("user", t)]} for t in texts))
    assert [(r.a, r.b) for r in dedup.exact_pairs(df, prefix=None).collect()] == [("r2", "r3")]


def test_large_buckets_lose_no_link(spark, monkeypatch):
    words = [f"w{i}" for i in range(100)]
    family = [" ".join([*words[:i], "new", *words[i + 1 :]]) for i in range(10, 76)]
    df = records(spark, *({"messages": [("user", t)]} for t in ["a text that is unlike all the others", *family, family[3], family[3]]))
    # all sets meet in each band, the unlike one first
    monkeypatch.setattr(dedup, "signature", lambda sh, n=dedup.PERMUTATIONS: dedup.F.array_repeat(dedup.F.size(sh) * 0, n))
    got = {r.id: (r.keep_id, r.similarity) for r in dedup.near_groups(df).collect()}
    assert got == {f"r{i}": ("r1", 92 / 104) for i in range(1, 69)}


def test_near_groups_equal_brute_force(spark):
    import random

    r = random.Random(3)
    texts, vocabulary = [], [f"w{k}" for k in range(300)]
    for _ in range(40):
        t = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 40, 60]))]
        texts.append(t)
        for _ in range(r.randint(0, 4)):
            texts.append(copy := list(r.choice(texts)))
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
    sets = [frozenset(tuple(t[i : i + 3]) for i in range(max(1, len(t) - 2))) for t in texts]
    edges = [(i, j, len(x & y) / len(x | y)) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if len(x & y) / len(x | y) >= 0.5]
    group = list(range(len(texts)))
    for _ in texts:
        for i, j, _ in edges:
            group[i] = group[j] = min(group[i], group[j])
    want = {}
    for i, j, similarity in edges:
        for k in (i, j):
            want[f"r{k}"] = (f"r{group[k]}", min(similarity, *(s for a, _, s in edges if group[a] == group[k])))
    df = records(spark, *({"messages": [("user", " ".join(t))]} for t in [*texts, []]))
    got = {r.id: (r.keep_id, r.similarity) for r in dedup.near_groups(df, 0.5, prefix=None).collect()}
    assert got == want and len(want) > 40


def test_longest_then_leftmost_window(spark):
    items = spark.createDataFrame([("b", "a b c d e"), ("b", "k l m n o p q"), ("b", "x y")], "benchmark string, text string")
    df = records(spark, {"messages": [("user", "a b c d e and K, l m n o p q")]}, {"messages": [("user", "x y")]})
    assert [(r.id, r.gram, r["at"]) for r in decontaminate.hits(df, items, n=6).collect()] == [("r0", "k l m n o p", 6)]


def test_filters_and_changes(spark):
    df = records(spark, {"messages": [("user", "Hello World")], "tags": ["a"], "quality_score": 30, "created_at": 5}, {"messages": [("user", "other")], "answer": "hello"}, {"messages": [("user", "third")]})
    assert sorted(r.id for r in filters.matching(df, filters.Filter(search=" HELLO ")).collect()) == ["r0", "r1"]
    assert [r.id for r in filters.matching(df, filters.Filter(max_score=50, tag="a")).collect()] == ["r0"]
    assert [r.id for r in filters.ordered(df).collect()] == ["r0", "r1", "r2"]
    ids = spark.createDataFrame([("r0",)], "id string")
    assert filters.tagged(df, ids, " b ", 9).filter("id = 'r0'").first().tags == ["a", "b"]
    assert filters.deleted(df, ids).count() == 2 and filters.duplicated(df, "r0", "new", 1).count() == 4


def test_split_counts(spark):
    df = records(spark, *({"messages": []} for _ in range(37)))
    got = {r.split: r.n for r in stats.counts(filters.auto_split(df, 0.1, 0.05), "split").collect()}
    assert got == {"validation": 4, "test": 2, "train": 31}


def test_templates(spark):
    m = [("system", "S"), ("user", "U"), {"role": "assistant", "content": "A", "reasoning": "R", "tool_calls": [{"id": "i", "name": "f", "arguments": '{"x": 1}'}]}]
    df = records(spark, {"messages": m})
    said = lambda family, **o: df.select(templates.render(F.col("messages"), family, **o)).first()[0]
    assert said("chatml") == '<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n<|im_start|>assistant\n<think>\nR\n</think>\n\nA\n<tool_call>\n{"name":"f","arguments":{"x":1}}\n</tool_call><|im_end|>\n'
    assert said("gemma", include_reasoning=False).startswith("<bos><start_of_turn>user\nS\n\nU<end_of_turn>\n<start_of_turn>model\nA\n")
    assert said("mistral-tekken") == '<s>[SYSTEM_PROMPT]S[/SYSTEM_PROMPT][INST]U[/INST][THINK]R[/THINK]A\n[TOOL_CALLS][{"name":"f","arguments":{"x":1},"id":"i"}]</s>'
    assert said("harmony").endswith('<|start|>assistant<|channel|>analysis<|message|>R<|end|><|start|>assistant<|channel|>commentary to=functions.f<|message|>{"x": 1}<|end|><|start|>assistant<|channel|>final<|message|>A<|return|>')
    assert said("phi4", generation_prompt=True).endswith("<|im_start|>assistant<|im_sep|>")
    assert all(said(f) for f in V.CONTROL_TOKENS)


def raw(spark, *own):
    return spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(own)], "seq long, raw string")


def test_layouts(spark):
    own = [
        {"prompt": "p", "chosen": "a", "rejected": "b"}, {"prompt": "p", "completion": "c", "label": 1}, {"messages": [{"role": "user", "content": "x"}]},
        {"conversations": [{"from": "human", "value": "x"}]}, {"prompt": "p", "answer": "a"}, {"t": "only"}, {"a": 1, "b": 2}, "[1]",
    ]
    got = [r.f for r in raw(spark, *own).orderBy("seq").select(classify(F.col("raw")).alias("f")).collect()]
    assert got == ["dpo-pairs", "kto-unpaired", "openai-messages", "sharegpt", "alpaca", "text", None, None]
    seen = detect(raw(spark, *[{"instruction": "i", "output": "o"}] * 3, {"a": 1, "b": 2}))
    assert (seen.format, seen.confidence, seen.mapping) == ("alpaca", 0.675, {"instruction": "instruction", "output": "output"}) and seen.warnings


def test_conversion(spark):
    own = [
        {"messages": [{"role": "human", "content": ["a", {"text": "b"}]}, {"role": "gpt", "content": "<think>why</think>so"}]},
        {"messages": [{"role": "user", "content": "q"}], "answer": "42"},
        {"messages": [{"role": "nobody", "content": "q"}]},
        {"prompt": "p", "chosen": "a", "rejected": [{"role": "assistant", "content": "b"}]},
    ]
    good, bad = convert(raw(spark, *own))
    rows_ = good.orderBy("seq").collect()
    assert [(m.role, m.content, m.reasoning) for m in rows_[0].messages] == [("user", "ab", None), ("assistant", "so", "why")]
    assert [(r.type, r.answer) for r in rows_] == [("sft", None), ("rl", "42"), ("preference", None)]
    assert [r.error for r in bad.collect()] == ["Row 2: a message without a known role or content"]


def test_conversion_parses_a_row_once(spark, tmp_path):
    from grainmill.plans import queries

    spark.createDataFrame([(1, "some text", "en", "web"), (2, " ", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for query in (queries.convert_alpaca, queries.convert_dpo):
        df = query(spark, str(tmp_path))
        assert [r.seq for r in df.collect()] == [1]
        assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    _, bad = convert(raw(spark, {"instruction": "i", "output": " "}))
    assert bad._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1
    assert [r.error for r in bad.collect()] == ["Row 0: a message without a known role or content"]


def test_exports(spark, tmp_path):
    df = records(spark, {"type": "preference", "messages": [("system", "s"), ("user", "q")], "chosen": [("assistant", "good")], "rejected": [("assistant", "bad")]}, {"messages": [("user", "q"), ("assistant", "a")], "split": "test", "tools": [{"name": "f", "parameters": '{"type": "object"}'}]})
    line = lambda *a, **k: json.loads(rows(df, Export(*a, **k)).first().line)
    assert line("axolotl", "preference") == {"prompt": "s\n\nq", "chosen": "good", "rejected": "bad"}
    assert line("trl", "preference", include_system=False)["prompt"] == [{"role": "user", "content": "q"}]
    assert line("openai-ft", "preference")["preferred_output"] == [{"role": "assistant", "content": "good"}]
    assert line("openai-ft") == {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "tools": [{"type": "function", "function": {"name": "f", "parameters": {"type": "object"}}}], "parallel_tool_calls": False}
    assert line("ms-swift", "preference")["rejected_response"] == "bad"
    assert json.loads(line("llama-factory")["tools"])[0] == {"name": "f", "description": "", "parameters": {"type": "object"}}
    assert not supported("llama-factory", "rl") and slug(" My Set! ") == "my_set"
    meta = bundle(df, Export(), str(tmp_path / "out"))
    assert (meta["exported"], meta["bySplit"]) == (1, {"test": 1}) and (tmp_path / "out" / "split=test").exists()


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes('﻿{"a": 1}\r\n\r\nnope{\r\n{"b": [2]}\r\n'.encode())
    good, bad = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert [json.loads(r.raw) for r in good.collect()] == [{"a": 1}, {"b": [2]}] and bad.count() == 1
    (tmp_path / "b.json").write_text('{"data": [{"x": 1}, {"x": 2}]}')
    assert [json.loads(r.raw)["x"] for r in readers.read_json(spark, str(tmp_path / "b.json")).collect()] == [1, 2]
    (tmp_path / "c.csv").write_text('q ;a\n"one\ntwo";{"k": 1}\n')
    assert [json.loads(r.raw) for r in readers.read_csv(spark, str(tmp_path / "c.csv")).collect()] == [{"q": "one\ntwo", "a": {"k": 1}}]
    assert readers.sniff("x.bin", b'{"a":1}\n{"b":2}') == "jsonl" and readers.sniff("x", b"PAR1") == "parquet" and readers.sniff("a.MD", b"") == "text"


def test_documents():
    body = "Intro\n\n## Question 1: What?\nmore\nA: Because.\nline\n\nQ: empty\nA:\n**Q:** Two? \n**A:** Yes."
    assert documents.qa_pairs(body) == [("What?\nmore", "Because.\nline"), ("Two?", "Yes.")]
    text = ("word " * 30).strip() + ".\n\n" + "next " * 30
    pieces = documents.chunk_text(text, 200, 20)
    assert pieces[0].endswith(".") and len(pieces) == 2 and documents.chunk_text(" ") == []


def test_model_calls_are_cached_and_retried(spark):
    df = records(spark, {"messages": [("user", "q"), ("assistant", "a")]}, {"messages": [("user", "boom")]})
    requests = generate.judge_requests(df)

    def chat(messages):
        if "boom" in messages[0]["content"]:
            raise ValueError("no")
        return 'sure: {"helpfulness": 12, "correctness": 5, "clarity": 4, "verdict": "pass"}'

    answers = generate.run_batch(requests, chat)
    assert generate.status(answers) == {"status": "completed", "total": 2, "failed": 1, "errors": ["ValueError: no"]}
    got = {r.id: (r.helpfulness, r.verdict, r.score) for r in generate.judged(requests, answers).collect()}
    assert got == {"r0": (10.0, "pass", 63), "r1": (None, None, None)}
    good = answers.filter("error is null")
    again = generate.run_batch(requests.filter("id = 'r0'"), lambda m: 1 / 0, cache=good)
    assert [r.error for r in again.collect()] == [None]
    assert generate.strict_json("```json\n[1]\n```") == [1] and generate.strict_json("none") is None


def test_split_keeps_every_row(spark):
    from grainmill.operators import filters

    ids = [None, None] + [str(i % 40) for i in range(300)]
    df = spark.createDataFrame([(x, "train", 1, 2) for x in ids], "id string, split string, _h int, _n int")
    got = filters.auto_split(df, 0.1, 0.1)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted(str(r.id) for r in rows) == sorted(map(str, ids))
    assert sum(r.split == "validation" for r in rows) == sum(r.split == "test" for r in rows) == 30
