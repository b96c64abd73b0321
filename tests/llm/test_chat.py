import hashlib
import random

from tessera.llm import chat


def test_query_equals_sql(spark, sf_dir, same_rows):
    same_rows(chat.op6_chat(spark, sf_dir), chat.OP6_SQL)


def _escape(text):
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def test_odd_conversations(spark, odd_dir):
    rows = sorted(spark.read.parquet(f"{odd_dir}/conversations.parquet").collect(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    for got in chat.op6_chat(spark, odd_dir).collect():
        own = [r for r in rows if r["conv_id"] == got["conv_id"]] if got["conv_id"] != -1 else None
        turns = [(r["role"] or "", r["text"] or "") for r in own] if own is not None else [("user", chat.PROBE_TEXT), ("assistant", chat.PROBE_TEXT)]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got["n_turns"] == len(turns)
        assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_examples_are_prefixes(spark, odd_dir):
    """Each assistant turn is one example: all before it as prompt, itself as target."""
    rows = spark.read.parquet(f"{odd_dir}/conversations.parquet").where("conv_id IS NOT NULL")
    by = {}
    for r in sorted(rows.collect(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
        by.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    want = []
    for conv, turns in by.items():
        text, n = "", 0
        for role, body in turns:
            head = "<|im_start|>" + _escape(role).replace("\n", "<\\n") + "\n"
            if role == "assistant":
                want.append((conv, n, text + head, _escape(body)))
                n += 1
            text += head + _escape(body) + "<|im_end|>\n"
    got = [(r["conv_id"], r["example"], r["prompt"], r["target"]) for r in chat.materialize_examples(rows).collect()]
    assert sorted(got) == sorted(want)


def test_query_reads_expanded_examples(spark, odd_dir):
    """The query's own rows are the examples, and reading them back shuffles nothing a second time."""
    rows = spark.read.parquet(f"{odd_dir}/conversations.parquet").where("conv_id IS NOT NULL")
    want = sorted(map(tuple, chat.materialize_examples(rows).select("conv_id", "prompt", "target").collect()))
    made = chat.example_rows(chat.format_conversations(rows)).where("target IS NOT NULL").select("conv_id", "prompt", "target")
    assert sorted(map(tuple, made.collect())) == want
    plan = chat.op6_chat(spark, odd_dir)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan and plan.count("Exchange hashpartitioning") == 1


def test_any_role_and_text_read_back(spark, tmp_path):
    rng = random.Random(3)
    pieces = ["\\", "n", "\n", "<", "|", "<|", "<\\|", "\\n", "<\\n", "im_end|>", "<|im_start|>", "a", " "]
    some = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))
    turns = {c: [(k, rng.choice([some(), "assistant", "a\\name"]), some()) for k in range(rng.randint(1, 5))] for c in range(200)}
    spark.createDataFrame([(c, *t) for c, ts in turns.items() for t in ts], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op6_chat(spark, str(tmp_path)).collect()}
    for c, ts in turns.items():
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in ts).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(t for _, r, t in ts if r == "assistant").encode()).hexdigest()


def test_no_python_in_the_plan(spark, sf_dir):
    plan = chat.op6_chat(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
