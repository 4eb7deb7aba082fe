"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record's nested field paths that are present (of those that any mapping names; others don't matter) are
hashed; the hash is looked up among the mappings' own hashes, and the mapping says where roles and texts
are. Canonical turns are written with a template whose control strings cannot occur in a text: inside
texts a backslash goes behind the first character of each control string, and one more where there are
backslashes already, so that removing one gives the text back. Only DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The template's control strings, and others that models take as such.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join(sorted({"\\Q" + c[1:] + "\\E" for c in CONTROL}))
ESCAPE, UNESCAPE = rf"([<\[])(\\*(?:{_REST}))", rf"([<\[])\\(\\*(?:{_REST}))"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """``turns``: (role, path) of single fields, or one (role path, text path) into the elements of ``each``."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    optional: tuple[str, ...] = ()
    roles: dict = field(default_factory=dict, hash=False)

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(f"{self.each}[].{p}" for t in self.turns for p in t) if self.each else tuple(p for _, p in self.turns)

    def layouts(self) -> Iterator[tuple[str, ...]]:
        """All sets of paths that the mapping covers."""
        must = [p for p in self.paths if p not in self.optional]
        for k in range(len(self.optional) + 1):
            for some in combinations(self.optional, k):
                yield tuple(sorted({*must, *some}))


MAPPINGS = (
    Mapping("messages", (("role", "content"),), each="messages", optional=("system",)),
    Mapping("turns", (("role", "text"),), each="turns", optional=("system",)),
    Mapping("share", (("from", "value"),), each="conversations", optional=("system",), roles=ROLES),
    Mapping("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("question", (("system", "system"), ("user", "question"), ("assistant", "answer")), optional=("system",)),
)
#: What a JSON record is read as: all that the mappings name.
SCHEMA = "system string, instruction string, input string, output string, prompt string, completion string, response string, question string, answer string, messages array<struct<role:string,content:string>>, turns array<struct<role:string,text:string>>, conversations array<struct<`from`:string,value:string>>"


def _known(columns: set[str], mappings) -> list[str]:
    paths = sorted({p for m in mappings for layout in m.layouts() for p in layout})
    return [p for p in paths if p.split("[]")[0] in columns]


def _present(path: str) -> Column:
    head, _, leaf = path.partition("[].")
    return F.exists(head, lambda e: e[leaf].isNotNull()) if leaf else F.col(head).isNotNull()


def fingerprint(columns: set[str], mappings=MAPPINGS) -> Column:
    """Hash of the known paths that are not null in this record."""
    return F.xxhash64(F.concat_ws("\n", *[F.when(_present(p), F.lit(p)) for p in _known(columns, mappings)]))


def _variants(m: Mapping, paths: tuple[str, ...]) -> list[tuple[str, ...]]:
    """A list whose elements lack one of the two fields everywhere still is that list."""
    return [paths] if not m.each else [tuple(sorted({*paths} - {*gone})) for gone in ((), *[(p,) for p in m.paths])]


def _turns(m: Mapping, layout: tuple[str, ...]) -> Column:
    text = lambda c: F.coalesce(c, F.lit("")).alias("text")
    system = [F.array(F.struct(F.lit("system").alias("role"), text(F.col("system"))))] if "system" in layout and m.each else []
    if m.each:
        r, t = m.turns[0]
        role = lambda e: F.coalesce(*[F.when(F.lower(e[r]) == a, b) for a, b in m.roles.items()], e[r], F.lit(""))
        return F.concat(*system, F.transform(m.each, lambda e: F.struct(role(e).alias("role"), text(e[t]))))
    if "input" in layout:  # the input is part of the instruction's turn
        return F.array(*[F.struct(F.lit(r).alias("role"), text(F.concat_ws("\n\n", p, "input") if p == "instruction" else F.col(p))) for r, p in m.turns if p in layout and p != "input"])
    return F.array(*[F.struct(F.lit(r).alias("role"), text(F.col(p))) for r, p in m.turns if p in layout])


def canonical(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """Adds ``layout`` (the mapping's name) and ``turns``; both are null where no mapping has the fingerprint.

    A record that has more known paths than one mapping names goes by the first mapping, in their order,
    that has the fingerprint of its own paths in it: the other fields are beside the conversation. Null
    texts and roles become empty; list elements keep their order; an empty list has no paths, so no
    mapping. Columns called ``layout`` or ``turns`` that no mapping reads are replaced; the others stay; an
    empty table stays empty.
    """
    columns = set(records.columns)
    known = set(_known(columns, mappings))
    told = []  # (whether a record has it, name, turns): the whole fingerprint first, then each mapping's own
    whole = fingerprint(columns, mappings)
    for own in (False, True):
        for m in mappings:
            mark = fingerprint(columns, (m,)) if own else whole
            told += [(mark == F.xxhash64(F.lit("\n".join(v))), m.name, _turns(m, paths)) for paths in m.layouts() if {*paths} <= known for v in _variants(m, paths)]
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for here, name, made in reversed(told):
        layout, turns = F.when(here, name).otherwise(layout), F.when(here, made).otherwise(turns)
    return records.withColumns({"layout": layout, "turns": turns})


def from_json(records: DataFrame, column: str) -> DataFrame:
    """Heterogeneous JSON texts as the columns that ``canonical`` reads.

    Other columns stay, but for those called like a field of the JSON, which gives way to it. Texts that are
    no JSON object have no fields.
    """
    spark = records.sparkSession
    fields = spark.createDataFrame([], SCHEMA).columns
    own = [F.col(f"`{c}`") for c in records.columns if c not in fields]
    return records.select(*own, F.from_json(F.col(f"`{column}`"), SCHEMA).alias("_json")).select(*own, *[F.col("_json")[f].alias(f) for f in fields])


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def formatted(records: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss`` (start and end, code points, of each assistant text in it) from ``turns``.

    A record without a mapping (null turns) has neither: both are null, so it can be told from one without turns.
    """
    parts = F.transform(F.coalesce("turns", F.array().cast(TURNS)), lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), escaped(t["role"]), F.lit(SEP)).alias("head"), escaped(t["text"]).alias("body")))
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
        F.when(t["role"] == "assistant", F.concat(acc["loss"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))).otherwise(acc["loss"]).alias("loss"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    some = F.col("turns").isNotNull()
    return records.withColumns({"formatted": F.when(some, F.array_join(F.transform(parts, lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")), "loss": F.when(some, F.aggregate(parts, zero, step)["loss"])})


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(text, r"\Q" + END + r"\E", -1)
    head = lambda p: F.substring_index(p, SEP, 1)
    turn = lambda p: F.struct(unescaped(head(p).substr(F.lit(len(START) + 1), F.length(p))).alias("role"), unescaped(p.substr(F.length(head(p)) + len(SEP) + 1, F.length(p))).alias("text"))
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def masked(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(text.substr(s["start"] + 1, s["end"] - s["start"]))), "")


def gathered(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record for each conversation with a ``messages`` list, ordered by turn (null first), then role and text.

    A conversation is one record, so it has to fit in one row of an executor; conversations are dealt out by id.
    """
    own = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    return rows.groupBy(id).agg(F.transform(F.sort_array(F.collect_list(own)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    out = formatted(canonical(gathered(rows.union(extra))))
    back, loss = read_back(F.col("formatted")), masked(F.col("formatted"), F.col("loss"))
    out = out.select("conv_id", "formatted", back.alias("back"), loss.alias("under"))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = {
    "op3_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, regexp_replace(text, '([<\[])(\\*(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>))', '\1\\\2', 'g') AS esc FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
            sum(length(role) + length(esc) + 32)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id"""
}
QUERIES = {"op3_chat": op3_chat}
