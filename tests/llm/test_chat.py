import hashlib
import random

from pyspark.sql import functions as F

from tallyloft.llm import chat as C

KIND = "conv_id long, turn long, role string, text string"
TRICKY = ["</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "<\\s> <\\\\s>", "<<SYS>>x<</SYS>>", "", None, "a<", "[INST", "\\", "ends <|im_end|", "<|endoftext|>\n\n", "é😀" * 50]


def conversations():
    rng = random.Random(0)
    rows = []
    for c in range(40):
        for t in range(rng.choice([1, 2, 3, 9, 60])):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "assistant", "tool\n\\n", "<s>", None])
            rows.append((c, t, role, rng.choice(TRICKY) if rng.random() < 0.4 else "word " * rng.randint(1, 300)))
    rows += [(100, None, "user", "a"), (100, 1, "assistant", "b"), (100, 1, "assistant", "b"), (101, 0, "system", "alone"), (None, 0, "assistant", "no id"), (102, 5, "assistant", "x " * 20_000), (102, 6, "user", "y")]
    return rows


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_and_mask(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS window", "2 AS number", "3 AS size")
    for budget, history in ((2048, 256), (400, 100), (150, 0)):
        got = {r["conv_id"]: tuple(r)[1:5] for r in C.digests(C.windows(df, budget, history)).collect()}
        assert got == want(rows)


def test_windows_keep_budget_and_system_turn(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", "w " * 60) for t in range(1, 80)]
    out = C.windows(spark.createDataFrame(rows, KIND), 500, 120).orderBy("window").collect()
    assert len(out) > 3 and not any(r["over_budget"] for r in out)
    for r in out:
        assert r["tokens"] <= 500 and r["formatted"].startswith("<|im_start|>system\nbe kind<|im_end|>\n")
        spans = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert all(s == "w " * 60 for s in spans)
    assert all(r["n_context"] > 1 for r in out[1:]) and out[0]["n_context"] == 0
    assert sum(len(r["loss_spans"]) for r in out) == 39
    huge = C.windows(spark.createDataFrame([(1, 0, "user", "z" * 9000), (1, 1, "assistant", "q")], KIND), 500, 100)
    assert [r["over_budget"] for r in huge.orderBy("window").collect()].count(True) == 1


def test_escape_is_reversible_and_hides_control_strings(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY) if t is not None], "i int, t string")
    for r in df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u"), C.unescape_role(C.escape_role(F.col("t"))).alias("r")).collect():
        assert r["u"] == r["t"] == r["r"]
        assert not any(c in r["e"] for c in ("<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"))


def test_empty_and_native(spark):
    df = spark.createDataFrame([], KIND)
    assert C.windows(df).count() == 0
    plan = C.digests(C.windows(df))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def plain_windows(rows, budget, history):
    """(first own turn, own turns, repeated turns, tokens) of each window of each conversation, one turn after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        cost = [-(-len(t[3]) // 4) + 5 for t in turns]
        system = cost[0] if turns[0][2] == "system" else None
        kept = system is not None and system <= budget // 2
        longest = max([c for c in cost if c <= budget // 4], default=0)
        stride = max(budget // 4, budget - history - (system if kept else 0) - longest)
        keys, small, larges = [], 0, 0
        for i, c in enumerate(cost):
            if i == 0 and system is not None:
                keys.append((0, False, 0))
            elif c > budget // 4:
                keys.append((larges, True, 0))
                larges += 1
            else:
                keys.append((larges, False, small // stride))
                small += c
        done = []
        for key in dict.fromkeys(keys):
            own = [i for i, k in enumerate(keys) if k == key]
            past, used = [], 0
            for i in range(own[0] - 1, 0 if system is not None else -1, -1):
                used += cost[i]
                if used > history:
                    break
                past.append(i)
            again = own[0] > 0 and kept
            done.append((own[0], len(own), len(past) + again, sum(cost[i] for i in own + past) + (system if again else 0)))
        out[conv] = sorted(done)
    return out


def test_windows_against_plain_code(spark):
    rng = random.Random(5)
    rows = conversations()
    rows += [(200, t, "system" if t == 0 else "user", "w" * rng.choice([1, 40, 200, 400, 700, 3000])) for t in range(1400)]
    rows += [(201, t, "system" if t == 0 else "assistant", "w" * (5000 if t == 0 else 80)) for t in range(60)] + [(202, t, "system", "same") for t in (0, 0, 0, 1)]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    for budget, history in ((2048, 256), (400, 100), (160, 0)):
        got = {}
        for r in C.windows(df, budget, history).collect():
            got.setdefault(r["conv_id"], []).append((r["window"], r["n_turns"], r["n_context"], r["tokens"]))
        assert {c: sorted(w) for c, w in got.items()} == plain_windows(rows, budget, history)


def test_one_long_turn_does_not_break_a_conversation_up(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", "w" * (7180 if t == 300 else 40)) for t in range(601)]
    out = C.windows(spark.createDataFrame(rows, KIND)).collect()
    assert len(out) <= 10 and sum(len(r["formatted"]) for r in out) < 1.5 * sum(len(r[3]) + 30 for r in rows)
