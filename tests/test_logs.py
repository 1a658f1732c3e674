"""Log formats, validation, masking and sources on small hand-made inputs."""
import json
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from subsetlab.functions import answers
from subsetlab.operators import corpus, cost, features, logs, masking, runs
from subsetlab.plans import queries_logs
from subsetlab.sources import audits, rules, scans


def call(call_id, name, arguments):
    return {"id": call_id, "function": {"name": name, "arguments": arguments}}


def parse(spark, messages, log_format):
    text = json.dumps(messages)
    raw = spark.createDataFrame([("r", "repo__1", text)], "run string, trajectory string, value string").withColumn("messages", F.from_json("value", logs.RAW_MESSAGE)).drop("value")
    return logs.parse_messages(raw, log_format).orderBy("step_index").collect()


def test_look_ahead_of_three_messages_and_cursor(spark):
    messages = [
        {"role": "user", "content": [{"type": "text", "text": "<issue_description> fix it </issue_description>"}, {"type": "text", "text": "more"}]},
        {"role": "assistant", "content": "", "tool_calls": [call("a", "execute_bash", '{"command": "cd /x && A=1 ./run.sh"}'), call("b", "think", '{"thought": "hm"}')]},
        {"role": "user", "content": "noise"}, {"role": "user", "content": "noise"},
        {"role": "tool", "tool_call_id": "a", "content": "exit code 0"},                                     # distance 3: found
        {"role": "assistant", "content": "", "tool_calls": [call("c", "execute_bash", "not json")]},         # used as filler before b's answer
        {"role": "tool", "tool_call_id": "b", "content": "ok"},                                              # cursor jumps here, call c is skipped
        {"role": "assistant", "content": "", "tool_calls": [call("d", "execute_bash", "not json")]},
        {"role": "user", "content": "1"}, {"role": "user", "content": "2"}, {"role": "user", "content": "3"},
        {"role": "tool", "tool_call_id": "d", "content": "late"}]                                            # distance 4: not found
    steps = parse(spark, messages, "openhands")
    assert [(r["action_header"], r["action_command"], r["observation"]) for r in steps] == [
        ("execute_bash", "run.sh", "exit code 0"), ("think", "think", "ok"), ("execute_bash", "execute_bash", "")]
    assert steps[0]["task_description"] == "fix it"
    assert steps[2]["action"] == "execute_bash: not json"


def test_xml_calls_and_errors(spark):
    body = "<function=str_replace_editor>\n<parameter=command>str_replace</parameter>\n<parameter=path> /a.py </parameter><parameter=old_str>x\ny</parameter><parameter=new_str>x\nz\nw</parameter></function>"
    messages = [{"role": "assistant", "content": body}, {"role": "user", "content": "EXECUTION RESULT of it\nerror: Bad\nfine\nerror: Bad\nfinished with exit code 7"}]
    step = parse(spark, messages, "openhands")[0]
    assert (step["action"], step["edit_size"], step["files_touched"], step["error_message"]) == ("str_replace_editor: /a.py", 2, ["/a.py"], "error: Bad")


def test_tests_are_recognised(spark):
    def one(command, observation, log_format="openhands"):
        messages = [{"role": "assistant", "content": "", "tool_calls": [call("a", "execute_bash", json.dumps({"command": command}))]}, {"role": "tool", "tool_call_id": "a", "content": observation}]
        row = parse(spark, messages, log_format)[0]
        return row["tests_run"], row["tests_passed"]
    assert one("python -m pytest tests/test_a.py", "2 passed") == (["test_a.py"], ["some"])
    assert one("pytest -q", "1 failed, 2 passed") == (["pytest"], [])
    assert one("python my_verification.py", "success") == (["my_verification.py"], ["some"])
    assert one("python my_verification.py", "success", "rebench") == ([], [])
    assert one("ls my_test.py", "") == ([], [])


def test_last_tool_message_wins_by_id(spark):
    messages = [{"role": "assistant", "content": "", "tool_calls": [call("a", "bash", '{"command": "ls"}'), call("z", "task_done", "{}")]},
                {"role": "tool", "tool_call_id": "a", "content": "old"}, {"role": "tool", "tool_call_id": "a", "content": "new"}]
    steps = parse(spark, messages, "trae")
    assert [(r["action"], r["observation"]) for r in steps] == [("bash: ls", "new"), ("finish", "")]
    described = parse(spark, [{"role": "user", "content": "Hi\n[Problem Statement]: ```python x ```"}, *messages], "trae")
    assert described[0]["task_description"] == "x"


def test_error_message_rules(spark):
    def error(text):
        return spark.createDataFrame([(text,)], "o string").select(logs.error_message(F.col("o"))).first()[0]
    assert error("Traceback (most recent call last):\n a\nexit code 0") == ""
    assert error("x\nTraceback (most recent call last):\n a\n") == "Traceback (most recent call last):\n a"
    assert error("no code, error") == ""
    assert error("nothing\nexit code 12") == "Command failed with exit code 12"


def test_triangular_cost_caps_tool_messages(spark):
    rows = [("r", 1, 0, "user", "x" * 40, None), ("r", 1, 1, "assistant", "y" * 8, [{"id": "a", "function": {"name": "abcd", "arguments": "z" * 10}}]),
            ("r", 1, 2, "tool", "t" * 100_000, None), ("r", 1, 3, "assistant", "w" * 4, None)]
    schema = "run string, instance long, pos long, role string, text string, tool_calls array<struct<id:string,function:struct<name:string,arguments:string>>>"
    whole = cost.trajectory_costs(spark.createDataFrame(rows, schema)).first()
    assert whole["input_tokens"] == 10 + (10 + 5 + 25_000) and "cut_tokens" not in whole.asDict()
    row = cost.trajectory_costs(spark.createDataFrame(rows, schema), observation_cap=10_000).first()
    assert row["cut_tokens"] == 15_000
    assert row["output_tokens"] == (2 + 1 + 2) + 1          # 10 / 4 = 2.5 rounds to 2
    assert row["input_tokens"] == 10 + (10 + 5 + 10_000)
    assert row["flat_tokens"] == 10 + 5 + 25_000 + 1


def masked(spark, text, repository="acme/widget-kit", rule_set="multi_model"):
    df = spark.createDataFrame([(text, repository)], "text string, repository string")
    return masking.mask_texts(df, ["text"], rules.RULE_SETS[rule_set], df).first()["text"]


def test_masking_rules(spark):
    assert masked(spark, "MyWidgetFactory here") == "[REPO_VAR] here"
    assert masked(spark, "3 passed and 4 5 more, été fatal Error") == "[NUM] more été [ERR_FATAL] [ERR_GENERIC]"
    assert masked(spark, "error error /a/b /c/d") == "[ERR_GENERIC] [ERR_GENERIC] [PATH]"
    assert masked(spark, "12 the 13") == "[NUM]"
    assert masked(spark, "MyWidgetFactory kit", rule_set="single_setup") == "MyWidgetFactory"
    assert masked(spark, None) == ""


def test_repository_terms_are_removed_in_any_number(spark):
    df = spark.createDataFrame([("acme kit other acme", "acme/kit"), ("", "some/name"), ("name word 7 8", "some/name"), (None, None)], "text string, repository string")
    many = df.select("repository").unionByName(spark.range(3000).selectExpr("concat('owner', id, '/project', id) AS repository"))
    masked = masking.mask_texts(df.withColumn("more", F.lit("kit project7 word")), ["text", "more"], rules.RULE_SETS["single_setup"], many).collect()
    assert sorted(r["text"] for r in masked)[:2] == ["", ""] and len(masked) == 4
    left = {w for r in masked for w in (r["text"] + " " + r["more"]).split()}
    assert {"other", "word"} <= left and not left & {"acme", "kit", "project7", "name"}


def test_content_type_decides_what_is_a_list(spark):
    raw = spark.createDataFrame([('[{"role":"tool","content":"[{\\"id\\": 1}]"},{"role":"user","content":[{"type":"text","text":"part"},{"text":"two"}]},{"role":"user","content":null},{"role":"user","content":[]}]',)], "v string")
    messages = raw.select(F.from_json("v", logs.RAW_MESSAGE).alias("messages"))
    got = messages.select(F.transform("messages", lambda m: logs.message_text(m["content"])).alias("t"), F.transform("messages", lambda m: logs.message_text(m["content"], True)).alias("a")).first()
    assert got["t"] == ['[{"id": 1}]', "part", "", ""] and got["a"] == ['[{"id": 1}]', "part\ntwo", "", ""]


def test_escapes_of_dictionary_arguments_are_decoded(spark):
    df = spark.createDataFrame([("{'file_text': 'a\\nb\\nit\\'s \\\\n'}",), ("file_text='a\\nb'",), ("x",)], "arguments string")
    assert [r[0] for r in df.select(logs._quoted(F.col("arguments"), "file_text")).collect()] == ["a\nb\nit's \\n", "a\\nb", None]


def test_evaluation_without_a_verdict_is_not_resolved(spark):
    trees = spark.createDataFrame([('{"trajectory_id":"t","evaluation_result":{},"nodes":[{"node_id":1,"action_steps":[{"action":"{}"}]}]}',), ('{"trajectory_id":"u","nodes":[{"node_id":1,"action_steps":[{"action":"{}"}]}]}',)], "v string")
    steps = logs.parse_node_trees(trees.select(F.from_json("v", logs.NODE_SCHEMA).alias("t")).select("t.*"))
    assert {r["trajectory_id"]: r["evaluated"] for r in steps.collect()} == {"t": False, "u": None}


def test_steps_without_raw_text_are_reported(spark):
    steps = spark.createDataFrame([("r", "t", 1, "bash", "bash: ls", "", "")], "run string, trajectory string, step_index int, action_header string, action string, observation string, error_message string")
    raw = spark.createDataFrame([], "run string, trajectory string, raw_text string")
    assert [r["problems"] for r in logs.step_problems(steps, raw).collect()] == [["no raw text"]]


def test_shapes_and_types(spark):
    row = spark.createDataFrame([("Ab1_é-Zc",)], "t string").select(corpus.token_shape(F.col("t")).alias("s"), corpus.token_type(F.lit("deadbeef")).alias("h")).first()
    assert (row["s"], row["h"]) == ("Ccd_c-Cc", "hex/hash")


def test_outcome_probe_beats_the_majority_on_separable_text(spark):
    docs = spark.range(300).select(F.col("id").alias("doc"), (F.col("id") % 2 == 0).alias("passed"),
                                   F.concat(F.lit("common words "), F.when(F.col("id") % 2 == 0, "alpha beta").otherwise("gamma delta")).alias("text"))
    summary, words = corpus.outcome_probe(docs)
    row = summary.first()
    assert row["accuracy"] > 0.95 > row["majority_rate"]
    assert {r["word"] for r in words.where("coefficient > 0.1").collect()} == {"alpha", "beta"}


def test_features_without_steps_are_missing(spark):
    steps = spark.createDataFrame([("r", 1, "execute_bash", 3, "", ["f"], ["t"], "abc"), ("r", 1, "think", 0, "boom", ["f", "g"], [], "")],
                                  "run string, instance long, action_header string, edit_size int, error_message string, files_touched array<string>, tests_run array<string>, observation string")
    known = spark.createDataFrame([("r", 1), ("r", 2)], "run string, instance long")
    got = {r["instance"]: r for r in features.trajectory_features(steps, known).collect()}
    assert (got[1]["n_steps"], got[1]["n_errors"], got[1]["n_unique_files"], got[1]["frac_bash"]) == (2, 1, 2, 0.5)
    assert all(got[2][f] is None for f in features.FEATURES)
    constant = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 5.0), ("g", 3, None)], "g string, instance int, n_steps double")
    assert {r["n_steps"] for r in features.standardised(constant, ["g"], ["n_steps"]).collect()} == {0.0}


def test_resolved_flags(spark):
    values = spark.createDataFrame([("1",), ("True",), ("success",), ("0",), (None,), ("2",)], "v string")
    assert [r[0] for r in values.select(runs.resolved_flag(F.col("v"))).collect()] == [1, 1, 1, 0, 0, 0]


def test_overlapping_blocks_stop_the_job(spark):
    a, b = spark.range(3).withColumn("v", F.lit(1)), spark.range(3, 5).withColumn("v", F.lit(1))
    assert audits.union_blocks([a, b], ["id"]).count() == 5
    with pytest.raises(Exception, match="block overlap"):
        audits.union_blocks([a, a.limit(1)], ["id"]).collect()


def test_run_dimension(spark):
    table = audits.run_dimension(spark, {"one": {"runs": ("x", "y"), "parser": "openhands", "rules": "multi_model", "run_parsers": {"y": "trae"}},
                                         "two": {"run_groups": (2, 3), "parser": "rebench", "rules": "single_setup"}})
    rows = {(r["dataset"], r["run"]): (r["ordinal"], r["parser"]) for r in table.collect()}
    assert rows[("one", "y")] == (1, "trae") and rows[("two", "3_runs/run_3")] == (4, "rebench") and len(rows) == 7


def test_unreadable_logs_are_null(spark, tmp_path):
    for name, text in (("a", '[{"role": "user", "content": "hi"}]'), ("b", "{broken")):
        folder = tmp_path / "run_1"
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.json").write_text(text)
    rows = {r["trajectory"]: r["messages"] for r in scans.scan_message_logs(spark, str(tmp_path), r"run_(\d+)/", r"/(\w+)\.json").collect()}
    assert rows["b"] is None and rows["a"][0]["content"].toPython() == "hi"


def plain_answers(messages, by_id):
    """(call, answer text) of every step, comparing every call with every message it may look at."""
    out, cursor = [], -1
    for i, m in enumerate(messages):
        if not by_id and i <= cursor:
            continue
        if m["calls"]:
            cursor = i
        for c in m["calls"]:
            near = messages if by_id else messages[cursor + 1:cursor + 1 + logs.LOOK_AHEAD]
            hits = [n for n, a in enumerate(near) if (a["role"] == "tool" and a["tool_call_id"] == c["id"] and (c["id"] is not None or not by_id))
                    or (not by_id and c["id"] == logs.XML_CALL_ID and a["role"] == "user" and logs.RESULT_MARKER in a["text"])]
            hit = hits[-1] if by_id and hits else hits[0] if hits else None
            out.append((c["name"], near[hit]["text"] if hit is not None else ""))
            if hit is not None and not by_id:
                cursor += hit + 1
    return out


@pytest.mark.parametrize("by_id", [True, False])
def test_answers_equal_a_plain_search(spark, by_id):
    import random
    draw = random.Random(5)
    ids = ["a", "b", "c", None, logs.XML_CALL_ID]
    rows = []
    for n in range(120):
        messages = [{"role": draw.choice(["assistant", "tool", "tool", "user"]), "text": draw.choice(["x", "EXECUTION RESULT y", ""]) + str(i), "tool_call_id": draw.choice(ids),
                     "calls": []} for i in range(draw.randrange(0, 25))]
        for m in messages:
            if m["role"] == "assistant":
                m["calls"] = [{"id": draw.choice(ids), "name": f"n{draw.random()}", "arguments": "{}"} for _ in range(draw.randrange(0, 4))]
        rows.append((n, messages))
    df = spark.createDataFrame([*rows, (-1, None)], f"trajectory long, messages array<{logs.MESSAGE}>")
    steps = (logs.steps_by_id if by_id else logs.steps_by_look_ahead)(df).orderBy("trajectory", "step_index").collect()
    assert not [r for r in steps if r["trajectory"] == -1]
    for n, messages in rows:
        mine = [r for r in steps if r["trajectory"] == n]
        assert [(r["name"], r["observation"]) for r in mine] == plain_answers(messages, by_id)
        assert [r["step_index"] for r in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("search", [logs.steps_by_id, logs.steps_by_look_ahead])
def test_conversation_of_twenty_thousand_messages(spark, search):
    import time
    message = ("CASE WHEN i % 2 = 0 THEN named_struct('role', 'assistant', 'text', '', 'tool_call_id', CAST(NULL AS string), 'calls', array(named_struct('id', concat('call', i), 'name', 'bash', 'arguments', '{}'))) "
               f"ELSE named_struct('role', 'tool', 'text', concat('output', i - 1), 'tool_call_id', concat('call', i - 1), 'calls', cast(array() AS array<{logs.CALL}>)) END")
    conversation = spark.range(1).select(F.expr(f"transform(sequence(0, 19999), i -> {message})").alias("messages"))
    started = time.time()
    got = search(conversation).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("observation") == F.concat(F.lit("output"), (2 * (F.col("step_index") - 1)).cast("string"))).cast("int")).alias("hits")).first()
    assert tuple(got) == (10_000, 10_000)
    assert time.time() - started < 15   # comparing all calls with all messages takes minutes


def test_trajectory_without_steps_keeps_its_description(spark):
    steps = spark.createDataFrame([("r", "a", "task a", 2, "run", "out"), ("r", "a", "task a", 1, "look", None)], "run string, trajectory string, task_description string, step_index int, action string, observation string")
    every = spark.createDataFrame([("r", "a", "task a"), ("r", "b", "task b"), ("r", "c", None)], "run string, trajectory string, task_description string")
    texts = {r["trajectory"]: r["text"] for r in corpus.trajectory_text(steps, trajectories=every).collect()}
    assert texts == {"a": "task a look run out", "b": "task b", "c": ""}
    assert {r["trajectory"] for r in corpus.trajectory_text(steps).collect()} == {"a"}


def test_lines_are_placed_once_and_messages_are_not_shuffled(spark):
    plan = queries_logs.conversations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange " in line]
    assert len(exchanges) == 1 and plan.index("Exchange ") > plan.index("Window ") > plan.index("collect_list")


def test_features_read_the_steps_once_and_count_a_step_with_several_files_once(spark):
    steps = spark.createDataFrame([("r", 1, "think", 2, "", ["f", "g", None], [], "ab"), ("r", 1, "think", 4, "boom", None, ["t"], ""), ("r", 1, "think", 6, "", ["g", "f"], ["t"], "")],
                                  "run string, instance long, action_header string, edit_size int, error_message string, files_touched array<string>, tests_run array<string>, observation string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        calls.add(1)
        return text
    seen = features.trajectory_features(steps.withColumn("observation", counted("observation")), steps.select("run", "instance")).collect()
    assert [(r["n_steps"], r["n_edit_steps"], r["n_errors"], r["n_test_steps"], r["n_unique_files"]) for r in seen] == [(3, 3, 1, 2, 3)]
    assert seen[0]["total_edit_log"] == pytest.approx(math.log1p(12)) and seen[0]["mean_obs_len_log"] == pytest.approx(math.log1p(2) / 3)
    plan = features.trajectory_features(steps.withColumn("observation", counted("observation")), steps.select("run", "instance"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and calls.value == 3


def test_problems_are_counted_in_one_pass_over_steps_with_their_text(spark):
    steps = spark.createDataFrame([("r", "t", 1, "bash", "bash: ls", "", "", "bash ls"), ("r", "t", 2, "bash", "bash: rm", "gone", "", "bash ls"), ("r", "t", 3, "cat", "cat: ls", "", "", None)],
                                  "run string, trajectory string, step_index int, action_header string, action string, observation string, error_message string, raw_text string")
    summary = logs.problem_summary(logs.step_problems(steps))
    assert {(r["check"], r["steps"], r["failing"]) for r in summary.collect()} == {
        ("", 3, 2), ("action payload", None, 1), ("observation", None, 1), ("no raw text", None, 1)}
    assert summary._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1


def test_answers_over_batches_with_missing_ids_and_conversations():
    kinds, ids = pa.array([[0, 1, 0, 2], None, [1, 0, 1]], pa.list_(pa.int8())), pa.array([[None, "a", None, None], None, ["b", None, None]])
    calls = pa.array([[["a"], [], ["xml"], []], None, [[], ["b", None], None]])
    ahead = answers._over_batches(lambda k, i, c, marked: answers.search_ahead(k, i, c, 3, marked), kinds, ids, calls, "xml").to_pylist()
    assert [f and [tuple(p.values()) for p in f] for f in ahead] == [[(0, 0, 1), (2, 0, 3)], None, [(1, 0, -1), (1, 1, 2)]]
    by_id = answers._over_batches(lambda k, i, c, marked: answers.search_by_id(k, i, c), kinds.slice(1), ids.slice(1), calls.slice(1)).to_pylist()
    assert [f and [tuple(p.values()) for p in f] for f in by_id] == [None, [(1, 0, 0), (1, 1, -1)]]
