"""Column functions over graded runs: statuses, gates, preferences, routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages and commands that a sandbox accepts, and languages with a command for each of them.
COMMANDS = ("TEST", "COMPILE", "LINT", "FORMAT", "STATIC_ANALYSIS")
LANGUAGES = ("python", "java", "javascript", "typescript", "shell", "c", "cpp", "go", "rust")
MAPPED = ("python", "java", "javascript", "shell")
MOST_SECONDS, USUAL_SECONDS = 300, 60

# Keys of a task that a model may see, keys that cases of a baseline need, and keys they mustn't have.
VISIBLE = ("task_id", "task_type", "repository_snapshot_id", "prompt", "allowed_tools", "language", "timeout_seconds", "requiresTools", "dialect")
REQUIRED_CASE_KEYS = ("id", "category", "taskId", "candidate", "expectedStatus", "expectedPassed")
FORBIDDEN_CASE_KEYS = ("command", "argv", "hiddenTest", "hidden_test", "testCommand", "compileCommand")


def visible(columns: list[str]) -> list[str]:
    """The columns of a task that a model may see."""
    return [c for c in columns if c in VISIBLE]


def status(applicable: Column, invalid: Column, unapplied: Column, compile_: dict[str, Column], test: dict[str, Column], collected: Column, workspace_error: Column, internal_error: Column) -> Column:
    """What became of a graded candidate; the first stage that fails counts. Stages have timed_out, policy and passed."""
    return (
        F.when(~applicable, "NOT_APPLICABLE").when(invalid, "CANDIDATE_INVALID").when(workspace_error, "WORKSPACE_ERROR").when(internal_error, "INTERNAL_ERROR").when(unapplied, "PATCH_APPLY_FAIL")
        .when(compile_["timed_out"], "SANDBOX_TIMEOUT").when(compile_["policy"], "SANDBOX_POLICY").when(~compile_["passed"], "COMPILE_FAIL")
        .when(test["timed_out"], "SANDBOX_TIMEOUT").when(test["policy"], "SANDBOX_POLICY").when(collected == 0, "NO_TESTS").when(test["passed"], "PASS").otherwise("TEST_FAIL")
    )


def sandbox_decision(workspace: Column, command: Column, language: Column, seconds: Column, extra: Column, free_form: Column) -> Column:
    """allowed, or the first rule that a request breaks; a timeout of 0 or null is the usual one."""
    limit = F.coalesce(F.nullif(seconds, F.lit(0)), F.lit(USUAL_SECONDS))
    return (
        F.when(~workspace.rlike(r"^[A-Za-z0-9_-]{1,128}$"), "workspace").when(~F.upper(command).isin(*COMMANDS), "command").when(~F.lower(language).isin(*LANGUAGES), "language")
        .when(limit < 1, "timeout too short").when(limit > MOST_SECONDS, "timeout too long").when(~F.lower(language).isin(*MAPPED), "no command map").when(extra, "extra fields").when(free_form, "free-form command").otherwise("allowed")
    )


def run_outcome(succeeded: Column, timed_out: Column, calls: Column, budget: int) -> Column:
    """How a repair run ended."""
    return F.when(succeeded, "success").when(timed_out, "timeout").when(calls > budget, "tool-budget-exhausted").otherwise("exhausted")


def gate(requested: list[tuple[Column, Column]]) -> Column:
    """All requested parts hold, and one at least was requested; parts are (requested, holds)."""
    some, every = F.lit(False), F.lit(True)
    for asked, holds in requested:
        some, every = some | asked, every & (~asked | holds)
    return some & every


def preferred(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """True if a is better than b, false if b is, null on a tie: tests, compiling, then fewest failures, findings, lines and edits."""
    out = F.lit(None).cast("boolean")
    for key in ("unnecessary_edits", "patch_size", "security_findings", "new_failures"):
        out = F.when(a[key] != b[key], a[key] < b[key]).otherwise(out)
    for key in ("compiles", "tests_pass"):
        out = F.when(a[key] != b[key], a[key]).otherwise(out)
    return out


def repo_size(files: Column, chunks: Column) -> Column:
    return F.when((files <= 30) & (chunks <= 300), "small").when((files <= 150) & (chunks <= 2000), "medium").otherwise("large")


def infeasible(ram: Column, vram: Column, context: Column, tools: Column, loaded: Column, has_ram: Column, has_vram: Column, needs_context: Column, needs_tools: Column) -> Column:
    """Labels of the constraints that a candidate model breaks, in order."""
    labels = F.array(
        F.when(ram > has_ram, "ram-over-available"), F.when(vram > has_vram, "vram-over-available"), F.when(context < needs_context, "context-too-small"),
        F.when(needs_tools & ~tools, "tools-unsupported"), F.when(~loaded, "not-loaded"),
    )
    return F.filter(labels, lambda x: x.isNotNull())


def utility(quality: Column, history: Column, latency: Column, ram: Column, vram: Column, most_latency: Column, most_ram: Column, most_vram: Column) -> Column:
    """Weighted quality less latency, memory and risk; a maximum of 0 or null counts as 1."""
    one = lambda x: F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(1.0))
    return quality - 0.2 * (latency / one(most_latency)) - 0.1 * (ram / one(most_ram) + vram / one(most_vram)) / 2 - 0.5 * (1.0 - (0.7 * quality + 0.3 * history))
