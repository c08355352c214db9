"""What a tool call is: edit, validation, navigation; its shape; its verb."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import fixed_values as V
from spoor.functions import text as X
from spoor.workspace import is_mcp


def is_tool_call() -> Column:
    return F.col("entry_type") == "tool_call"


def is_user_message() -> Column:
    return (F.col("entry_type") == "message") & (F.col("role") == "user")


def is_edit() -> Column:
    return is_tool_call() & F.col("tool_name").isin(V.EDIT_TOOLS)


def _shell() -> Column:
    return F.col("tool_name").isin(V.SHELL_TOOLS) & F.col("command").isNotNull()


def is_validation() -> Column:
    return is_tool_call() & _shell() & X.starts_with_any(F.col("command"), V.VALIDATION_PREFIXES)


def is_read() -> Column:
    return is_tool_call() & (
        F.col("tool_name").isin(V.READ_TOOLS)
        | (_shell() & X.starts_with_any(F.col("command"), V.READ_PREFIXES))
    )


def loop_shape(command: Column, file_path: Column) -> Column:
    """Argument shape for loop detection: quoted strings and paths collapse, the
    rest of the command stays readable. Empty when there is no argument."""
    s = X.trim_all(command)
    s = F.regexp_replace(s, "'[^']*'", "<str>")
    s = F.regexp_replace(s, '"[^"]*"', "<str>")
    s = F.regexp_replace(s, rf"{X.NOT_WS}*[/.]{X.NOT_WS}*", "<path>")
    s = F.regexp_replace(s, rf"{X.WS}+", " ")
    return F.coalesce(F.when(command != "", s), file_path, F.lit(""))


def motif_shape(tool: Column, command: Column, file_path: Column) -> Column:
    """Coarse shape: first word of a Bash command, else the file extension."""
    word = F.regexp_extract(command, rf"^{X.WS}*({X.NOT_WS}+)", 1)
    ext = F.regexp_extract(file_path, r"(\.[^./\\]+)\z", 1)
    return (
        F.when((tool == "Bash") & (command != ""), word)
        .when(file_path != "", ext)
        .otherwise("")
    )


def pascal_tool(tool: Column) -> Column:
    """Tool name with an upper-case initial; MCP names stay as they are."""
    initial = F.upper(F.substring(tool, 1, 1))
    rest = F.substring(tool, F.lit(2), F.length(tool))
    return F.when(is_mcp(tool), tool).otherwise(F.concat(initial, rest))


_ENV = rf"^(?:[A-Za-z_][A-Za-z0-9_]*={X.NOT_WS}*(?:{X.WS}+|\z))+"
_FLAGS = rf"^(?:-{X.NOT_WS}*(?:{X.WS}+|\z))+"
_WORD = rf"^({X.NOT_WS}+)"
CLEAN_WORD = r"^[A-Za-z0-9_./+-]+\z"


def with_verb(df: DataFrame, command: str = "command") -> DataFrame:
    """Adds ``verb`` and ``sub`` of a shell command: leading assignments and flags
    are skipped; NULL when the word cannot stand in an allow entry.

    Built in steps, each a column, so that no expression is evaluated twice.
    """
    def word(c: str) -> Column:
        return F.regexp_extract(c, _WORD, 1)

    def clean(c: str) -> Column:
        return F.when(F.col(c).rlike(CLEAN_WORD), F.col(c))

    return (
        df.withColumn("_rest", F.regexp_replace(F.regexp_replace(X.trim_all(F.col(command)), _ENV, ""), _FLAGS, ""))
        .withColumns({
            "_verb": word("_rest"),
            "_tail": F.regexp_replace(F.regexp_replace("_rest", rf"^{X.NOT_WS}+{X.WS}*", ""), _FLAGS, "")})
        .withColumn("_sub", word("_tail"))
        .withColumn("verb", clean("_verb"))
        .withColumn("sub", F.when(F.col("verb").isNotNull(), clean("_sub")))
        .drop("_rest", "_verb", "_tail", "_sub")
    )


def is_test_path(path: Column) -> Column:
    return path.rlike("(?i)" + V.TEST_PATH)
