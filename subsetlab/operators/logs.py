"""Flattening of raw message logs into steps.

A conversation is one row (one raw file) with an array of messages; it becomes one row per step. Everything is column
expressions; the only sequential part, the search for the message that answers a call, sees the ids of that row's messages.
"""
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import VariantType

from ..functions import answers

# Markers, keywords and patterns of the supported log formats.
XML_CALL_ID = "xml_parsed"
RESULT_MARKER = "EXECUTION RESULT"
LOOK_AHEAD = 3
EXIT_CODE = r"(?:exit code|finished with exit code)\s*(\d+)"
TRACEBACK = r"(?s)(Traceback \(most recent call last\):.*)"
ERROR_KEYWORDS = ("error", "exception", "traceback", "failed", "fatal", "syntaxerror",
                  "no such file or directory", "command not found", "permission denied")
TEST_COMMANDS = ("pytest", "py.test", "python -m pytest", "python3 -m pytest",
                 "python -m unittest", "python3 -m unittest", "unittest discover")
TEST_SCRIPT = r"(?U)\b(\w*test\w*\.py|\w*reproduce\w*\.py|\w*verify\w*\.py|\w*verification\w*\.py)\b"
TEST_SCRIPT_SHORT = r"(?U)\b(\w*test\w*\.py|\w*reproduce\w*\.py|\w*verify\w*\.py)\b"
PASS_MARK = "✅"

WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"   # as (?U)\s

CALL = "struct<id:string,name:string,arguments:string>"
MESSAGE = f"struct<role:string,text:string,tool_call_id:string,calls:array<{CALL}>>"
RAW_MESSAGE = ("array<struct<role:string,content:variant,tool_call_id:string,"
               "tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>")
STEP_FIELDS = ("action", "action_header", "action_command", "files_touched", "tests_run", "tests_passed", "edit_size", "error_message", "observation")


def strip(text: Column) -> Column:
    """Text without surrounding white space of any kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def message_text(content: Column, all_parts: bool = False) -> Column:
    """Text of a message whose content (a variant) is a string or a list of parts: the first part, or all parts joined by newlines.

    The JSON type decides, so a plain string that looks like a list stays as it is.
    """
    parts = F.try_variant_get(content, "$", "array<struct<text:string>>")
    text = F.get(parts, F.lit(0))["text"] if not all_parts else F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    is_list = F.startswith(F.schema_of_variant(content), F.lit("ARRAY"))
    return F.coalesce(F.when(is_list, F.coalesce(text, F.lit(""))).otherwise(F.try_variant_get(content, "$", "string")), F.lit(""))


def xml_calls(text: Column) -> Column:
    """Calls written as ``<function=NAME><parameter=KEY>VALUE</parameter></function>``; arguments as a JSON object."""
    names = F.regexp_extract_all(text, F.lit(r"(?s)<function=(.*?)>(.*?)</function>"), 1)
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<function=(.*?)>(.*?)</function>"), 2)
    parameter = F.lit(r"(?s)<parameter=(.*?)>(.*?)</parameter>")
    # A key that occurs twice keeps its first place and its last value.
    def arguments(body):
        keys = F.transform(F.regexp_extract_all(body, parameter, 1), strip)
        values = F.transform(F.regexp_extract_all(body, parameter, 2), strip)
        last = F.transform(F.array_distinct(keys), lambda k: F.struct(
            k.alias("key"), F.element_at(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"] == k), -1)["v"].alias("value")))
        return F.coalesce(F.to_json(F.map_from_entries(last)), F.lit("{}"))
    return F.zip_with(names, bodies, lambda name, body: F.struct(F.lit(XML_CALL_ID).alias("id"), strip(name).alias("name"), arguments(body).alias("arguments")))


def unify_messages(raw: DataFrame, column: str = "messages", xml: bool = True) -> DataFrame:
    """Raw messages → (role, text, tool_call_id, calls); only assistant messages keep calls, XML calls where there are no others.

    Content is a variant as scanned from JSON, or a string, which is then the text.
    """
    typed = isinstance(raw.schema[column].dataType.elementType["content"].dataType, VariantType)

    def one(m):
        text = message_text(m["content"]) if typed else F.coalesce(m["content"], F.lit(""))
        structured = F.transform(m["tool_calls"], lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments")))
        written = xml_calls(text) if xml else F.array().cast(f"array<{CALL}>")
        calls = F.when(m["role"] != "assistant", F.array().cast(f"array<{CALL}>")).when(F.size(structured) > 0, structured).otherwise(written)
        return F.struct(m["role"].alias("role"), text.alias("text"), m["tool_call_id"].alias("tool_call_id"), F.coalesce(calls, F.array().cast(f"array<{CALL}>")).alias("calls"))
    return raw.withColumn(column, F.transform(column, one))


def explode_computed(rows: DataFrame, others, array: Column) -> DataFrame:
    """Explode a computed array into (``_at``, ``_s``).

    The outer form is used on purpose: for the inner form the optimizer infers a "not empty" filter and pushes it below the
    projection, which computes the whole array a second time.
    """
    return rows.select(*others, F.posexplode_outer(array).alias("_at", "_s")).where(F.col("_at").isNotNull())


def answered_steps(messages: DataFrame, found: Column, column: str) -> DataFrame:
    """One row per (message, call, answer) position in ``found``; a call without an answer has an empty observation.

    The texts are read from the row's own message array before it is exploded, so the array is not copied per step.
    """
    others = [c for c in messages.columns if c not in (column, "_found")]

    def step(at):
        call = F.get(F.get(column, at["message"])["calls"], at["call"])
        return F.struct(call["name"].alias("name"), call["arguments"].alias("arguments"),
                        F.when(at["answer"] < 0, "").otherwise(F.get(column, at["answer"])["text"]).alias("observation"))
    located = messages.withColumn("_found", found)
    return (explode_computed(located, others, F.transform("_found", step))
            .select(*others, (F.col("_at") + 1).alias("step_index"), "_s.name", "_s.arguments", "_s.observation"))


def call_ids(column: str) -> Column:
    """Ids of the calls of every message."""
    return F.transform(column, lambda m: F.transform(m["calls"], lambda c: c["id"]))


def steps_by_look_ahead(messages: DataFrame, column: str = "messages", look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """One row per call; the observation is the first of the next messages that answers it.

    The search starts behind the last used observation and messages before a found observation are skipped, so the calls of one
    conversation depend on each other. The kinds and ids of a conversation's messages, not its texts, pass through one linear search.
    """
    marked = lambda m: (m["role"] == "user") & F.contains(m["text"], F.lit(RESULT_MARKER))
    kinds = F.transform(column, lambda m: F.when(m["role"] == "tool", answers.TOOL).when(marked(m), answers.MARKED).otherwise(answers.OTHER).cast("tinyint"))
    find = answers.by_look_ahead(look_ahead, XML_CALL_ID)
    return answered_steps(messages, find(kinds, F.transform(column, lambda m: m["tool_call_id"]), call_ids(column)), column)


def steps_by_id(messages: DataFrame, column: str = "messages") -> DataFrame:
    """One row per call; the observation is the last tool message with the call's id, found by one linear search over the ids."""
    kinds = F.transform(column, lambda m: F.when(m["role"] == "tool", answers.TOOL).otherwise(answers.OTHER).cast("tinyint"))
    return answered_steps(messages, answers.by_id(kinds, F.transform(column, lambda m: m["tool_call_id"]), call_ids(column)), column)


def command_name(line: Column) -> Column:
    """Program a shell line runs: leading ``cd ... &&`` and VAR=value words skipped, ``./`` dropped."""
    behind = F.when(F.startswith(line, F.lit("cd ")) & F.contains(line, F.lit(" && ")), F.get(F.split(line, " && ", 2), F.lit(1))).otherwise(line)
    words = F.filter(F.split(strip(behind), r"(?U)\s+"), lambda w: w != "")
    first = F.coalesce(F.get(F.filter(words, lambda w: ~F.contains(w, F.lit("="))), F.lit(0)), F.get(words, F.lit(0)), F.lit(""))
    name = F.when(F.startswith(first, F.lit("./")), F.substring(first, 3, 1 << 30)).otherwise(first)
    return F.when(name == "", "empty_command").otherwise(name)


def line_count(text: Column) -> Column:
    """Number of lines."""
    return F.size(F.split(text, "\n"))


def edit_size(before: Column, after: Column) -> Column:
    """Changed lines between two texts: lines that differ at the same place plus the difference in length."""
    a, b = F.split(before, "\n"), F.split(after, "\n")
    shared = F.least(F.size(a), F.size(b))
    differing = F.size(F.filter(F.zip_with(F.slice(a, F.lit(1), shared), F.slice(b, F.lit(1), shared), lambda x, y: x != y), lambda d: d))
    return differing + F.abs(F.size(a) - F.size(b))


def error_message(observation: Column, longest_line=None) -> Column:
    """Error of an observation: none at exit code 0, else the traceback, else the keyword lines of a failed command (shorter than ``longest_line``, if given)."""
    code = F.regexp_extract(observation, EXIT_CODE, 1)
    trace = F.regexp_extract(observation, TRACEBACK, 1)
    lines = F.transform(F.split(observation, "\n"), strip)
    keyword = lambda line: F.lower(line).rlike("|".join(ERROR_KEYWORDS))
    short = F.array_distinct(F.filter(lines, lambda l: (l != "") & (F.length(l) < longest_line if longest_line else F.lit(True)) & keyword(l)))
    failed = F.concat(F.lit("Command failed with exit code "), F.regexp_replace(code, "^0+(?=\\d)", ""))
    is_zero = code.rlike("^0+$")
    return (F.when(F.coalesce(observation, F.lit("")) == "", "").when(is_zero, "").when(trace != "", strip(trace)).when(code == "", "")
            .when(F.size(short) > 0, F.array_join(short, "\n")).otherwise(failed))


def test_name(line: Column, script_pattern: str = TEST_SCRIPT) -> Column:
    """Test script or runner a shell line starts, null when it runs no test."""
    lowered = F.lower(line)
    runner = lowered.rlike("|".join(c.replace(".", r"\.") for c in TEST_COMMANDS))
    named, script = F.regexp_extract(lowered, r"(?U)\b(test_\w+\.py)\b", 1), F.regexp_extract(lowered, script_pattern, 1)
    return (F.when(runner, F.when(named != "", named).otherwise("pytest"))
            .when((script != "") & F.contains(lowered, F.lit("python")), script))


def looks_passed(observation: Column) -> Column:
    """Does the output of a test run look passed?"""
    lowered = F.lower(observation)
    good = F.contains(lowered, F.lit("passed")) | F.contains(observation, F.lit(PASS_MARK)) | F.contains(lowered, F.lit("success"))
    return good & ~F.contains(lowered, F.lit("failed"))


def _strings(*values) -> Column:
    """Array of strings."""
    return F.array(*values).cast("array<string>")


def with_step_fields(steps: DataFrame, log_format: str) -> DataFrame:
    """Step fields of calls (name, arguments, observation) of one message format; unreadable arguments keep their raw text.

    Formats: ``openhands`` and ``rebench`` (JSON or XML calls), ``trae`` and ``refact`` (calls answered by id).
    """
    name, raw = F.col("name"), F.col("arguments")
    parsed = F.from_json(raw, "map<string,string>")
    steps = steps.withColumn("_args", parsed).withColumn("_ok", parsed.isNotNull())
    argument = lambda key: F.try_element_at(F.col("_args"), F.lit(key))
    text = lambda key: F.coalesce(argument(key), F.lit(""))
    path, command = argument("path"), text("command")
    is_shell = F.col("_ok") & name.isin(*{"trae": ("bash",), "refact": ("execute_bash", "shell")}.get(log_format, ("execute_bash",)))
    is_editor = F.col("_ok") & (name == "str_replace_editor")
    has_path = F.coalesce(path, F.lit("")) != ""
    touched = F.when(has_path, _strings(path)).otherwise(_strings())
    created = F.when(text("file_text") != "", line_count(text("file_text"))).otherwise(0)
    changed = edit_size(text("old_str"), text("new_str"))
    plain = F.concat(name, F.lit(": "), raw)
    ran = test_name(command, TEST_SCRIPT_SHORT if log_format == "rebench" else TEST_SCRIPT)
    action, called, files, size = plain, name, _strings(), F.lit(0)
    if log_format in ("openhands", "rebench"):
        verb = F.coalesce(argument("command"), F.lit("view"))
        action = (F.when(is_shell, F.concat(F.lit("execute_bash: "), command))
                  .when(is_editor, F.concat(F.lit("str_replace_editor: "), F.coalesce(path, F.lit("None"))))
                  .when(F.col("_ok") & (name == "think"), F.concat(F.lit("think: "), text("thought"))).otherwise(plain))
        called = F.when(is_shell, command_name(command)).when(is_editor, verb).otherwise(name)
        files = F.when(is_editor, touched).otherwise(_strings())
        size = F.when(is_editor & (verb == "create"), created).when(is_editor & (verb == "str_replace"), changed).otherwise(0)
    elif log_format == "trae":
        detail = F.coalesce(*[F.when(text(k) != "", argument(k)) for k in ("function_name", "class_name", "file_name")], F.lit("project"))
        known = F.col("_ok")
        action = (F.when(is_shell, F.concat(F.lit("bash: "), command))
                  .when(is_editor, F.concat(command, F.lit(": "), F.when(has_path, path).otherwise("N/A")))
                  .when(known & (name == "ckg_tool"), F.concat(command, F.lit(": "), detail))
                  .when(known & (name == "sequential_thinking"), F.concat(F.lit("think: "), text("thought")))
                  .when(known & (name == "task_done"), "finish")
                  .when(known, F.concat(name, F.lit(": "), F.when(command != "", command).otherwise(raw))).otherwise(plain))
        called = (F.when(is_shell, command_name(command)).when(is_editor | (known & (name == "ckg_tool")), command)
                  .when(known & (name == "sequential_thinking"), "think").when(known & (name == "task_done"), "finish").otherwise(name))
        files = F.when(is_editor, touched).otherwise(_strings())
        size = (F.when(is_editor & (command == "create"), F.when(text("file_text") != "", line_count(F.regexp_replace(text("file_text"), r"\r?\n$", ""))).otherwise(0))
                .when(is_editor & (command == "str_replace"), changed).otherwise(0))
    elif log_format == "refact":
        documents = F.col("_ok") & name.isin("create_textdoc", "update_textdoc")
        filed = F.col("_ok") & ~is_shell & ~documents & name.rlike("file|editor|replace|cat")
        steps = steps.withColumn("_listed", F.from_json(argument("paths"), "array<string>"))
        listed = F.col("_listed")
        several = F.when(path.isNull() & listed.isNotNull(), listed)
        single = F.coalesce(path, F.when(listed.isNull(), argument("paths")))
        shown = F.when(several.isNotNull(), F.array_join(several, ", ")).otherwise(F.coalesce(single, F.lit("")))
        action = (F.when(is_shell, F.concat(F.lit("execute_bash: "), command))
                  .when(filed, F.concat(name, F.lit(": "), F.when(shown != "", shown).otherwise(raw))).otherwise(plain))
        called = F.when(is_shell, command_name(command)).otherwise(name)
        files = (F.when(documents, touched).when(filed & several.isNotNull(), several)
                 .when(filed & (F.coalesce(single, F.lit("")) != ""), _strings(single)).otherwise(_strings()))
        size = (F.when(documents & (name == "create_textdoc"), line_count(text("content")))
                .when(documents, edit_size(text("old_str"), text("replacement"))).otherwise(0))
    else:
        raise ValueError(f"unknown message format {log_format!r}")
    tested = is_shell & ran.isNotNull()
    return (steps.withColumn("action", action).withColumn("action_header", name).withColumn("action_command", called)
            .withColumn("files_touched", files).withColumn("tests_run", F.when(tested, _strings(ran)).otherwise(_strings()))
            .withColumn("tests_passed", F.when(tested & looks_passed(F.col("observation")), _strings(F.lit("some"))).otherwise(_strings()))
            .withColumn("edit_size", size).withColumn("error_message", error_message(F.col("observation")))
            .drop("_args", "_ok", "_listed", "name", "arguments"))


def task_description(messages: Column, log_format: str) -> Column:
    """Issue text: from the first user message, by the format's own marker."""
    first = F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["text"], F.lit(""))
    if log_format in ("openhands", "rebench"):
        inside = F.regexp_extract(first, r"(?s)<issue_description>(.*?)</issue_description>", 1)
        return F.when(first.rlike(r"(?s)<issue_description>.*</issue_description>"), strip(inside)).otherwise(first)
    if log_format == "trae":
        marked = first.rlike(r"(?i)\[Problem statement\]:")
        body = strip(F.regexp_extract(first, r"(?is)\[Problem statement\]:\s*(.*)", 1))
        for fence in ("```python", "```julia", "```"):
            body = F.replace(body, F.lit(fence), F.lit(""))
        return F.when(marked, strip(body)).otherwise(strip(first))
    return strip(F.regexp_replace(strip(first), r"^`+|`+$", ""))


def with_identity(trajectories: DataFrame, resolved: DataFrame) -> DataFrame:
    """Outcome (id is in the run's resolved list) and repository (text before the first double underscore)."""
    listed = resolved.select("run", "trajectory").distinct().withColumn("_hit", F.lit(True))
    return (trajectories.join(listed, ["run", "trajectory"], "left")
            .withColumn("final_outcome", F.coalesce("_hit", F.lit(False))).drop("_hit")
            .withColumn("repository", F.substring_index("trajectory", "__", 1)))


def parse_messages(raw: DataFrame, log_format: str, column: str = "messages") -> DataFrame:
    """Raw conversations of one message format → one row per step, with the task description beside it."""
    by_cursor = log_format in ("openhands", "rebench")
    unified = unify_messages(raw, column, xml=by_cursor).withColumn("task_description", task_description(F.col(column), log_format))
    steps = steps_by_look_ahead(unified, column) if by_cursor else steps_by_id(unified, column)
    return with_step_fields(steps, log_format)


# Text logs

# Section signs of the text logs.
SECTION_END = r"(?=\n##|\n###|\z)"
OBSERVATION = r"(?s)### 👁️ Observation\n(.*?)" + SECTION_END
THINKING = r"(?s)### 🤔 Thinking\n(.*?)" + SECTION_END
EITHER = r"(?s)### (?:👁️ Observation|🤔 Thinking)\n(.*?)" + SECTION_END
ACTION = r"(?s)### (?:🎯 Action|📋 Conclusion)\n(.*?)" + SECTION_END
CONCLUSIONS = ("<observation>", "diff --git", "## Summary", "The final patch")


def _shorten(text: Column, shown_characters=None) -> Column:
    """The text, or its display form when a number of characters is given."""
    if shown_characters is None:
        return text
    return F.when(F.length(text) < shown_characters, text).otherwise(F.concat(F.substring(text, 1, shown_characters - 3), F.lit("...")))


def _unescaped(text: Column) -> Column:
    """Text of a quoted literal: escaped line ends, tabs, quotes and backslashes decoded."""
    parts = F.split(text, r"\\\\", -1)   # between doubled backslashes

    def decoded(part):
        for escape, character in (("n", "\n"), ("t", "\t"), ("r", "\r"), ("'", "'"), ('"', '"')):
            part = F.replace(part, F.lit("\\" + escape), F.lit(character))
        return part

    return F.array_join(F.transform(parts, decoded), "\\")


def _quoted(arguments: Column, key: str) -> Column:
    """Value of ``key='...'`` as it stands, or of a dictionary's ``'key': '...'`` with its escapes decoded; null when the key is absent."""
    literal = r"""(?:'((?:[^'\\]|\\.)*+)'|"((?:[^"\\]|\\.)*+)")"""

    def value(pattern):
        return F.when(arguments.rlike(pattern), F.concat(F.regexp_extract(arguments, pattern, 1), F.regexp_extract(arguments, pattern, 2)))

    return F.coalesce(value(rf"(?s)\b{key}\s*=\s*" + literal), _unescaped(value(rf"""(?s)['"]{key}['"]\s*:\s*""" + literal)))


def parse_text_logs(logs: DataFrame, text: str = "text", shown_characters=None) -> DataFrame:
    """Text logs → one row per ``## Step n`` section of the solver block; a tool result is the next section's observation.

    Actions are whole unless ``shown_characters`` asks for their display form.
    """
    solver = strip(F.regexp_extract(text, r"(?s)<problem_solver 0>(.*?)</problem_solver 0>", 1))
    described = logs.withColumn("task_description", strip(F.regexp_extract(text, r"(?s)<issue_description>(.*?)</issue_description>", 1)))
    others = [c for c in described.columns if c != text]
    split = described.select(*others, F.split(solver, r"\n## Step \d+\n").alias("_sections"))   # a column, or every section would split the log again
    paired = F.transform("_sections", lambda s, i: F.struct(s.alias("section"), F.coalesce(F.get("_sections", i + 1), F.lit("")).alias("next")))
    rows = (explode_computed(split, others, paired).where(F.col("_at") > 0)
            .select(*others, F.col("_at").alias("step_index"), "_s.section", "_s.next"))
    part = lambda column, pattern: strip(F.regexp_extract(column, pattern, 1))
    rows = (rows.withColumn("_own", part("section", OBSERVATION)).withColumn("_own", F.when(F.col("_own") != "", F.col("_own")).otherwise(part("section", THINKING))).withColumn("_action", part("section", ACTION)).withColumn("_has", F.col("section").rlike(ACTION))
            .withColumn("_result", part("next", OBSERVATION)).withColumn("_either", part("next", EITHER)))
    called = F.col("_action").rlike(r"(?s)^\w+\(.*\)")
    concluded = F.col("_action").rlike("^(" + "|".join(CONCLUSIONS) + ")")
    name = (F.when(~F.col("_has"), "think").when(called, F.regexp_extract("_action", r"(?s)^(\w+)\((.*)\)", 1)).when(concluded, "Conclusion").otherwise("unknown"))
    arguments = F.when(called, strip(F.regexp_extract("_action", r"(?s)^(\w+)\((.*)\)", 2))).otherwise(F.col("_action"))
    rows = rows.withColumn("name", name).withColumn("arguments", arguments)
    arg = lambda *keys: F.coalesce(*[_quoted(F.col("arguments"), k) for k in keys])
    has = F.col("_has")
    shell = has & F.col("name").isin("bash", "execute_bash")
    editor = has & (F.col("name") == "str_replace_based_edit_tool")
    viewer = has & F.col("name").isin("view_file_content", "view_directory", "search_files_by_keywords")
    asked, thought = has & (F.col("name") == "ask_repository_agent"), has & (F.col("name") == "think")
    final = has & (F.col("name") == "Conclusion")
    # Columns of their own, since each is read several times.
    rows = (rows.withColumn("_command", F.when(shell | editor, arg("command"))).withColumn("_line", F.when(shell, F.coalesce("_command", "arguments")))
            .withColumn("_path", F.when(editor, arg("path")).when(viewer, arg("file_name", "dir_path", "directory")))
            .withColumn("_text", F.when(editor & (F.col("_command") == "create"), arg("file_text"))).withColumn("_ran", test_name(F.col("_line"))))
    line, verb, path, ran = F.col("_line"), F.coalesce("_command", F.lit("view")), F.col("_path"), F.col("_ran")
    observation = (F.when(shell | asked, F.col("_either")).when((editor | viewer) & (F.col("_result") != ""), F.col("_result"))
                   .when(final & ~called, F.col("_action")).otherwise(F.col("_own")))
    shown = lambda prefix, value: F.concat(F.lit(prefix), _shorten(value, shown_characters))
    action = (F.when(~has, "think").when(shell, F.concat(F.lit("execute_bash: "), line))
              .when(thought, shown("think: ", F.coalesce(arg("thought"), F.col("arguments"))))
              .when(asked, shown("ask_repository_agent: ", F.coalesce(arg("query"), F.col("arguments"))))
              .when(final, "Conclusion: [See final patch / summary]")
              .otherwise(F.concat(F.col("name"), F.lit(": "), _shorten(F.col("arguments"), shown_characters))))
    size = (F.when(F.coalesce("_text", F.lit("")) != "", line_count(F.col("_text")))
            .when(editor & (verb == "str_replace"), edit_size(F.coalesce(arg("old_str"), F.lit("")), F.coalesce(arg("new_str"), F.lit("")))).otherwise(0))
    return (rows.withColumn("observation", observation)
            .withColumn("action", action).withColumn("action_header", F.when(shell, "bash").otherwise(F.col("name")))
            .withColumn("action_command", F.when(shell, command_name(line)).when(editor, verb).otherwise(F.col("name")))
            .withColumn("files_touched", F.when(F.coalesce(path, F.lit("")) != "", _strings(path)).otherwise(_strings()))
            .withColumn("tests_run", F.when(shell & ran.isNotNull(), _strings(ran)).otherwise(_strings()))
            .withColumn("tests_passed", F.when(shell & ran.isNotNull() & looks_passed(F.col("observation")), _strings(F.lit("some"))).otherwise(_strings()))
            .withColumn("edit_size", size)
            .withColumn("error_message", F.when(asked | final, "").otherwise(error_message(F.col("observation"))))
            .select(*others, "step_index", *STEP_FIELDS))


# Node trees

# Actions on files and the schema of a node tree.
FILE_ACTIONS = ("ReadFile", "StringReplace", "CreatePythonFile", "CreateFile")
NODE_SCHEMA = ("trajectory_id string, evaluation_result struct<resolved:boolean>, nodes array<struct<node_id:long,user_message:string,"
               "action_steps:array<struct<action:string,observation:struct<message:string>>>>>")


def parse_node_trees(trees: DataFrame) -> DataFrame:
    """Node trees → one row per action step in node order; the action object is kept as JSON text."""
    others = [c for c in trees.columns if c not in ("nodes", "evaluation_result")]
    flat = F.flatten(F.transform("nodes", lambda n: F.transform(n["action_steps"], lambda s: F.struct(
        n["node_id"].alias("node_id"), s["action"].alias("raw"), F.coalesce(s["observation"]["message"], F.lit("")).alias("observation")))))
    described = trees.withColumn("task_description", strip(F.coalesce(F.get("nodes", F.lit(0))["user_message"], F.lit(""))))
    steps = (described.select(*others, "task_description", F.when(F.col("evaluation_result").isNotNull(), F.coalesce("evaluation_result.resolved", F.lit(False))).alias("evaluated"), F.posexplode(flat).alias("_at", "_s"))
             .select(*others, "task_description", "evaluated", (F.col("_at") + 1).alias("step_index"), "_s.*"))
    field = lambda key: F.get_json_object("raw", f"$.{key}")
    cls = F.coalesce(field("action_args_class"), F.lit(""))
    kind = F.when(cls == "", "unknown").otherwise(F.replace(F.substring_index(cls, ".", -1), F.lit("Args"), F.lit("")))
    path = F.coalesce(F.when(field("file_path") != "", field("file_path")), field("path"))
    old, new = F.coalesce(field("old_str"), F.lit("")), F.coalesce(field("new_str"), F.lit(""))
    return (steps.withColumn("action_header", kind).withColumn("action_command", kind).withColumn("action", F.concat(kind, F.lit(": "), F.col("raw")))
            .withColumn("files_touched", F.when(kind.isin(*FILE_ACTIONS) & (F.coalesce(path, F.lit("")) != ""), _strings(path)).otherwise(_strings()))
            .withColumn("edit_size", F.when(kind == "StringReplace", F.abs(line_count(old) - line_count(new))).otherwise(0))
            .withColumn("tests_run", F.when(kind == "RunTests", F.coalesce(F.from_json(field("test_files"), "array<string>"), _strings())).otherwise(_strings()))
            .withColumn("tests_passed", F.when((kind == "RunTests") & F.contains(F.lower("observation"), F.lit("passed")), _strings(F.lit("some"))).otherwise(_strings()))
            .withColumn("error_message", error_message(F.col("observation"))).drop("raw"))


def outcome_with_fallback(evaluated: Column, listed: Column) -> Column:
    """A trajectory's own evaluation when present, else the run's resolved list."""
    return F.coalesce(evaluated, listed, F.lit(False))


# Validation

# Names and payloads that the parsers derive and no raw text holds.
DERIVED_NAMES = ("think", "unknown", "Conclusion", "bash")
DERIVED_PAYLOADS = ("None", "N/A", "think", "finish", "project", "[See final patch / summary]")


def step_problems(steps: DataFrame, raw: DataFrame = None, keys=("run", "trajectory")) -> DataFrame:
    """Checks a parsed step does not pass against its raw text; ``raw`` holds the raw text (JSON escapes decoded) per trajectory.

    Without ``raw`` the steps bring their ``raw_text`` along from the row they were parsed from, and neither side is shuffled.
    A step whose trajectory has no raw text is reported as such and not compared with it.
    """
    joined = steps if raw is None else steps.join(raw.select(*keys, "raw_text"), list(keys), "left")
    payload = F.when(F.contains("action", F.lit(": ")), F.get(F.split("action", ": ", 2), F.lit(1))).otherwise(F.col("action"))
    inside = lambda value: F.contains("raw_text", value)
    code = F.regexp_extract("observation", EXIT_CODE, 1)
    error = F.coalesce("error_message", F.lit("")) != ""
    checks = {"no raw text": F.col("raw_text").isNull(),
              "tool name": ~inside(F.col("action_header")) & ~F.col("action_header").isin(*DERIVED_NAMES),
              "action payload": (payload != "") & ~payload.isin(*DERIVED_PAYLOADS) & ~inside(F.regexp_replace(payload, r"\.\.\.$", "")),
              "observation": (F.col("observation") != "") & ~inside(F.col("observation")),
              "exit code 0 with an error recorded": code.rlike("^0+$") & error,
              "non-zero exit code without an error recorded": (code != "") & ~code.rlike("^0+$") & ~error}
    problems = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks.items()]))
    return joined.select(*keys, "step_index", problems.alias("problems"))


def problem_summary(checked: DataFrame) -> DataFrame:
    """Per run and check: number of steps that fail it (check is empty for the totals); the steps are checked once."""
    rows = checked.select("run", F.size("problems").alias("_n"), F.explode_outer(F.concat(F.array(F.lit("")), "problems")).alias("check"))
    return (rows.groupBy("run", "check").agg(F.count(F.lit(1)).alias("_rows"), F.sum((F.col("_n") > 0).cast("long")).alias("failing"))
            .select("run", "check", F.when(F.col("check") == "", F.col("_rows")).alias("steps"), "failing"))


def problem_examples(checked: DataFrame, limit: int = 20) -> DataFrame:
    """First failing steps in (run, trajectory, step) order."""
    return checked.where(F.size("problems") > 0).orderBy("run", "trajectory", "step_index").limit(limit)
