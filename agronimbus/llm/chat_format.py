r"""Conversations of many layouts as text with marked turns and a loss mask.

Layouts. A layout is the set of nested field paths that it needs (``messages[].role``)
and a declarative mapping from them to turns. The fingerprint of a table or of a record
is the SHA-256 of its field paths, sorted, among those that any layout knows; other
fields are ignored. It selects the mapping, so a table, or each record of a column of
JSON texts, gets its turns without a rule per file. Tables of unknown layout are
refused; JSON records of unknown layout come back without turns and with layout null.

Template. A turn is its text between the marks of its role (``MARKS``); any other role
stands, as JSON, in a mark of its own. A control string inside a text or a role gets a
backslash after its first character, one more if it has some already, which ``unescape``
takes off again; so no text can open or close a turn, and every text is read back as it
was. The loss mask holds the spans (code points of the formatted text) of the texts of
assistant turns, without marks.

Order is by turn (null first), then role, then text. Repeated rows are repeated turns.
Text null counts as empty, role null as the role of empty name, key null as a key. A
record without turns gives one row with an empty text. Conversations beyond
``piece_chars`` go on in a further row (``piece`` 1, 2, ...), cut between turns, so a
task holds one piece and never a whole conversation. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .shipping import ship

#: Marks before and after a turn's text, by role.
MARKS = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
    "user": ("[INST] ", " [/INST]\n"),
    "assistant": ("<s>", "</s>\n"),
}
#: What a text must not hold as it is: first characters, and what follows them.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]")
_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN = re.compile(rf"([<\[]\\*)(?={_REST})")
_ESCAPED = re.compile(rf"([<\[]\\*)\\(?={_REST})")
_OTHER = re.compile(r'\[ROLE ("(?:[^"\\]|\\.)*")\]\n', re.DOTALL)
PIECE_CHARS = 1 << 20
#: Characters of formatted text that are handed on at once.
BATCH_CHARS = 1 << 22


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"[ROLE {escape(json.dumps(role, ensure_ascii=False))}]\n", "\n[/ROLE]\n")


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text as it was, and the span of the text in it."""
    found, at = [], 0
    while at < len(formatted):
        for role, (opened, closed) in MARKS.items():
            if formatted.startswith(opened, at):
                begin = at + len(opened)
                break
        else:
            other = _OTHER.match(formatted, at)
            if not other:
                raise ValueError(f"no mark of a turn at {at}")
            role, begin, closed = json.loads(unescape(other[1])), other.end(), "\n[/ROLE]\n"
        # The text holds no closing mark, but its end and the mark may share no sign either.
        end = formatted.index(closed, begin)
        found.append((role, unescape(formatted[begin:end]), begin, end))
        at = end + len(closed)
    return found


# --- layouts ------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """How some field paths become turns.

    ``rows``: the row is a turn (order, role, text); ``fields``: turns of fixed roles, each
    of one or more fields (empty and missing ones left out, the rest two newlines apart);
    ``list``: an array of (role, text); ``pairs``: an array of (question, answer).
    """

    name: str
    kind: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)


OTHER_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn rows", "rows", ("turn", "role", "text")),
    Layout("messages", "list", ("messages[].role", "messages[].content")),
    Layout("from and value", "list", ("conversations[].from", "conversations[].value"), roles=OTHER_NAMES),
    Layout("prompt and completion", "fields", ("prompt", "completion"), ("system",),
           (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", "fields", ("prompt", "response"), ("system",),
           (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question and answer", "fields", ("question", "answer"), ("system",),
           (("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", "fields", ("instruction", "output"), ("input", "system"),
           (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("pairs", "pairs", ("history[].question", "history[].answer"), ("system",)),
)
KNOWN = frozenset(p for layout in LAYOUTS for p in (*layout.paths, *layout.optional))


def fingerprint(paths: Iterable[str]) -> str:
    """SHA-256 over the known ones of the field paths, sorted."""
    return hashlib.sha256("\n".join(sorted(KNOWN.intersection(paths))).encode()).hexdigest()


def _forms(layout: Layout) -> Iterator[tuple[str, ...]]:
    forms = [layout.paths]
    for extra in layout.optional:
        forms += [(*f, extra) for f in forms]
    yield from forms


BY_FINGERPRINT = {fingerprint(form): layout for layout in LAYOUTS for form in _forms(layout)}


def schema_paths(kind: DataType, path: str = "") -> Iterator[str]:
    """Field paths of a schema, ``[]`` for the entries of an array."""
    if isinstance(kind, StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{path}.{f.name}" if path else f.name)
    elif isinstance(kind, ArrayType):
        yield from schema_paths(kind.elementType, f"{path}[]")
    else:
        yield path


def value_paths(value, path: str = "") -> Iterator[str]:
    """Field paths of a parsed JSON value; null counts as a value, an empty array as its entries' layout."""
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from value_paths(inner, f"{path}.{name}" if path else name)
    elif isinstance(value, list):
        for inner in value:
            yield from value_paths(inner, f"{path}[]")
        if not value:
            yield from (p for p in KNOWN if p.startswith(f"{path}[]."))
    else:
        yield path


def canonical_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turn, role, text, empty, layout of a table whose layout its field paths tell.

    ``empty`` marks a record without turns. Columns that no layout knows are ignored.
    """
    layout = BY_FINGERPRINT.get(fingerprint(p for p in schema_paths(df.schema) if p != key))
    if layout is None:
        raise ValueError(f"no layout for the fields {sorted(schema_paths(df.schema))}")
    no, name = F.lit(False).alias("empty"), F.lit(layout.name).alias("layout")
    own = F.col(f"`{key}`").alias("key")
    if layout.kind == "rows":
        turn, role, text = layout.paths
        return df.select(own, F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"), no, name)
    found = _turn_array(df, layout)
    rows = df.select(own, F.posexplode_outer(found).alias("turn", "t"))
    return rows.select("key", F.col("turn").cast("bigint").alias("turn"), "t.role", "t.text", F.col("turn").isNull().alias("empty"), name)


def _turn_array(df: DataFrame, layout: Layout) -> Column:
    of = lambda role, text: F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))
    if layout.kind == "list":
        array, role, text = _array_parts(layout)
        names = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair]) if layout.roles else None
        called = (lambda r: F.coalesce(names[r], r)) if layout.roles else (lambda r: r)
        return F.transform(F.col(array), lambda m: of(called(m[role].cast("string")), m[text]))
    if layout.kind == "pairs":
        array, question, answer = _array_parts(layout)
        both = F.flatten(F.transform(F.col(array), lambda m: F.array(of(F.lit("user"), m[question]), of(F.lit("assistant"), m[answer]))))
        if "system" not in df.columns:
            return both
        first = F.when(F.col("system").isNotNull(), F.array(of(F.lit("system"), F.col("system"))))
        return F.concat(F.coalesce(first, F.expr("array()").cast(TURNS)), F.coalesce(both, F.expr("array()").cast(TURNS)))
    turns = []
    for role, fields in layout.fields:
        there = [f for f in fields if f in df.columns]
        if there:
            # The first field makes the turn; a system turn is there only with its text.
            text = F.concat_ws("\n\n", F.coalesce(F.col(there[0]).cast("string"), F.lit("")), *[F.nullif(F.col(f).cast("string"), F.lit("")) for f in there[1:]])
            turn = of(F.lit(role), text)
            turns.append(F.when(F.col(there[0]).isNotNull(), turn) if role == "system" else turn)
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


TURNS = "array<struct<role: string, text: string>>"


def _array_parts(layout: Layout) -> tuple[str, str, str]:
    array = layout.paths[0].split("[]")[0]
    return array, *(p.split("[].")[1] for p in layout.paths[:2])


def record_turns(record) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout name and (role, text) of one parsed JSON record; no layout: None and no turns."""
    layout = BY_FINGERPRINT.get(fingerprint(value_paths(record))) if isinstance(record, dict) else None
    if layout is None or layout.kind == "rows":
        return None, []
    as_text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if layout.kind == "fields":
        turns = []
        for role, fields in layout.fields:
            there = [record[f] for f in fields if f in record]
            if there and not (role == "system" and there[0] is None):
                turns.append((role, "\n\n".join([as_text(there[0]), *[as_text(v) for v in there[1:] if v not in (None, "")]])))
        return layout.name, turns
    array, left, right = _array_parts(layout)
    entries = [e if isinstance(e, dict) else {} for e in record.get(array) or []]
    if layout.kind == "list":
        return layout.name, [(layout.roles.get(as_text(e.get(left)), as_text(e.get(left))), as_text(e.get(right))) for e in entries]
    first = [("system", as_text(record["system"]))] if record.get("system") is not None else []
    return layout.name, first + [t for e in entries for t in (("user", as_text(e.get(left))), ("assistant", as_text(e.get(right))))]


def json_turns(df: DataFrame, key: str, column: str) -> DataFrame:
    """The same of a column of JSON texts, each with a layout of its own.

    What is no JSON object, or of unknown layout, is one row with ``empty`` and layout null.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, body in enumerate(b.column("record").to_pylist()):
                try:
                    layout, turns = record_turns(json.loads(body or ""))
                except ValueError:
                    layout, turns = None, []
                found = [(n, role, text, False, layout) for n, (role, text) in enumerate(turns)] or [(None, None, None, True, layout)]
                at += [i] * len(found)
                rows += found
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.record_batch([b.column("key").take(pa.array(at, pa.int64())), *columns], ["key", "turn", "role", "text", "empty", "layout"])

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").cast("string").alias("record"))
    return rows.mapInArrow(run, f"key {kind}, turn bigint, role string, text string, empty boolean, layout string")


# --- formatting and reading back ------------------------------------------------------


def _in_batches(rows: Iterator[tuple[int, list]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, each with its weight, as batches of bounded weight."""
    held, weight = [], 0
    for size, row in rows:
        held.append(row)
        weight += size + 64
        if weight >= BATCH_CHARS:
            yield pa.record_batch([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema)
            held, weight = [], 0
    if held:
        yield pa.record_batch([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema)


def format_turns(turns: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """key, piece, n_turns, formatted, loss (spans) of turns as ``canonical_turns`` gives them.

    Rows of a key lie together in one partition, pieces in order.
    """
    ship(turns.sparkSession)
    kind = turns.schema["key"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        current = None
        for b in batches:
            for key, role, text, empty in zip(*[b.column(c).to_pylist() for c in ("key", "role", "text", "empty")]):
                if current is None or current[0] != key or length >= piece_chars:
                    if current is not None:
                        yield length, [*current, n, "".join(parts), spans]
                    current = [key, current[1] + 1 if current is not None and current[0] == key else 0]
                    n, length, parts, spans = 0, 0, [], []
                if empty:
                    continue
                opened, closed = marks(role or "")
                body = escape(text or "")
                if role == "assistant":
                    spans.append({"start": length + len(opened), "end": length + len(opened) + len(body)})
                parts += [opened, body, closed]
                n, length = n + 1, length + len(opened) + len(body) + len(closed)
        if current is not None:
            yield length, [*current, n, "".join(parts), spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("key", first.schema.field("key").type), ("piece", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(span))])
        yield from _in_batches(pieces(b for some in ([first], batches) for b in some), schema)

    ordered = turns.select("key", "turn", "role", "text", "empty").repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    return ordered.mapInArrow(run, f"key {kind}, piece int, n_turns bigint, formatted string, loss array<struct<start: bigint, end: bigint>>")


def read_turns(formatted: DataFrame) -> DataFrame:
    """key, piece, place (of the turn in its piece), role, text, in_loss, from the formatted text and its spans alone."""
    ship(formatted.sparkSession)
    kind = formatted.schema["key"].dataType.simpleString()

    def rows(b: pa.RecordBatch) -> Iterator[tuple[int, list]]:
        for key, piece, body, loss in zip(*[b.column(c).to_pylist() for c in ("key", "piece", "formatted", "loss")]):
            masked = {(s["start"], s["end"]) for s in loss}
            for place, (role, text, begin, end) in enumerate(parse(body)):
                yield len(text), [key, piece, place, role, text, (begin, end) in masked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([("key", b.schema.field("key").type), ("piece", pa.int32()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("in_loss", pa.bool_())])
            yield from _in_batches(rows(b), schema)

    return formatted.mapInArrow(run, f"key {kind}, piece int, place bigint, role string, text string, in_loss boolean")


def digests(formatted: DataFrame) -> DataFrame:
    """Per key what the formatted pieces say: n_turns, digests of turns and of the text under the loss mask.

    ``formatted`` as ``format_turns`` returns it: pieces of a key together and in order.
    Each piece is read once; of a conversation only the state of its digests is held.
    """
    ship(formatted.sparkSession)
    kind = formatted.schema["key"].dataType.simpleString()

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        current = None
        for b in batches:
            for key, piece, body, loss in zip(*[b.column(c).to_pylist() for c in ("key", "piece", "formatted", "loss")]):
                if piece == 0:
                    if current is not None:
                        yield 0, [*current, turns.hexdigest(), masked, learned.hexdigest(), chars]
                    current, turns, learned, masked, chars = [key, 0], hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, text, _, _ in parse(body):
                    turns.update(f"{role}\n{text}\n".encode())
                    current[1] += 1
                for s in loss:
                    text = unescape(body[s["start"] : s["end"]])
                    learned.update(text.encode())
                    masked += len(text)
                chars += len(body)
        if current is not None:
            yield 0, [*current, turns.hexdigest(), masked, learned.hexdigest(), chars]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([("key", first.schema.field("key").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        yield from _in_batches(told(b for some in ([first], batches) for b in some), schema)

    return formatted.mapInArrow(run, f"key {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: A conversation of nothing but control strings.
PLANTED = "</s>[INST] ok [/INST]"


def formatted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], "conv_id bigint, turn bigint, role string, text string")
    turns = canonical_turns(given).unionByName(canonical_turns(planted))
    return digests(format_turns(turns)).withColumnRenamed("key", "conv_id")


QUERY = ("op12_chat_format", formatted_conversations)
SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{PLANTED}'), (-1, 1, 'assistant', '{PLANTED}')),
sized AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:{_REST})'))
                 + CASE {" ".join(f"role WHEN '{r}' THEN {len(a + b)}" if i == 0 else f"WHEN '{r}' THEN {len(a + b)}" for i, (r, (a, b)) in enumerate(MARKS.items()))}
                   ELSE 17 + length(to_json(role)) + len(regexp_extract_all(to_json(role)::VARCHAR, '[<\[]\\*(?:{_REST})')) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""
