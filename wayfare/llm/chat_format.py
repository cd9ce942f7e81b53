"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered to one text, which is encoded once, with the offsets of its tokens.  The spans of
the turns' texts and those of the tokens are both sorted, so the tokens of a span are found by binary search; what
token and span have in common is under the loss mask.  A text is therefore never encoded turn by turn, and a token
that reaches over a span's end counts with its part inside alone.

Inside texts and roles, the strings that steer the template are escaped: a backslash follows their first character,
and backslashes of the text are doubled.  That can be undone, and no text can end its turn or open another one.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ChatTemplate:
    """Each turn is begin + role + middle + text + end."""

    begin: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"
    #: Strings that must not occur inside a text as they are; each has two characters at least and no backslash.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: Whose texts are under the loss mask.
    learned: tuple[str, ...] = ("assistant",)

    def escape(self, text: str) -> str:
        doubled = text.replace("\\", "\\\\")
        return re.sub("|".join(map(re.escape, self.control)), lambda m: f"{m[0][0]}\\{m[0][1:]}", doubled)

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace("\n", "\\n")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\|n|(?=.))", lambda m: {"\\": "\\", "n": "\n", "": ""}[m[1]], text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], list[bool]]:
        """The conversation's text, the span of each turn's text in it, and whether it is learned."""
        out, spans, learned, at = [], [], [], 0
        for role, text in turns:
            head, body = f"{self.begin}{self.escape_role(role)}{self.middle}", self.escape(text)
            spans.append((at + len(head), at + len(head) + len(body)))
            learned.append(role in self.learned)
            out += [head, body, self.end]
            at = spans[-1][1] + len(self.end)
        return "".join(out), spans, learned

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a rendered conversation."""
        turns = []
        for part in formatted.split(self.begin)[1:]:
            role, _, rest = part.partition(self.middle)
            turns.append((self.unescape(role), self.unescape(rest.removesuffix(self.end))))
        return turns


def masked(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[list[bool], list[list[tuple[int, int]]]]:
    """Which tokens have a part in a span; for each span, its parts that tokens cover, joined where they touch.

    offsets and spans are sorted; the tokens of a span are found by binary search.
    """
    begins, ends = [a for a, _ in offsets], [b for _, b in offsets]
    mask, parts = [False] * len(offsets), []
    for a, b in spans:
        own: list[tuple[int, int]] = []
        for k in range(bisect_right(ends, a), bisect_left(begins, b)):
            lo, hi = max(a, begins[k]), min(b, ends[k])
            if lo < hi:
                mask[k] = True
                if own and lo <= own[-1][1]:
                    own[-1] = (own[-1][0], max(hi, own[-1][1]))
                else:
                    own.append((lo, hi))
        parts.append(own)
    return mask, parts


_loaded: dict = {}


def load(path: str):
    """The tokenizer at path, read once in each process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.encode_special_tokens = True
        _loaded[path] = found
    return _loaded[path]


FORMATTED = T.StructType([
    T.StructField("n_turns", T.LongType()),
    T.StructField("formatted", T.StringType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
    T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.LongType()))),
])

ARROW = pa.schema([
    ("n_turns", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())),
    ("loss_mask", pa.list_(pa.bool_())), ("loss_spans", pa.list_(pa.list_(pa.int64()))),
])


def grouped_turns(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id and its turns in order, as an array of structs (turn, role, text)."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = conversations.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return named.unionByName(conversations.filter(F.col("conv_id").isNull()).select("conv_id", F.array(turn).alias("turns")))


def format_conversations(conversations: DataFrame, path: str, template: ChatTemplate = ChatTemplate()) -> DataFrame:  # noqa: B008
    """One row for each conversation: conv_id, n_turns, formatted, ids, loss_mask, loss_spans.

    conversations has conv_id, turn, role and text; other columns are not read.  formatted is the rendered text, ids
    its tokens by the vocabulary file at path, loss_mask which of them are learned, loss_spans the [begin, end) code
    points under the mask.  Null texts and roles count as empty; turns of one number are ordered by role and
    text; repeated rows are turns of their own; each row without conv_id is a conversation of its own; an empty table
    gives no rows.  A conversation is one text and so must fit a task, as a document must.
    """
    grouped = grouped_turns(conversations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            rows = []
            for turns in batch.column(1).to_pylist():
                text, spans, learned = template.render([(t["role"], t["text"]) for t in turns])
                encoded = tokenizer.encode(text, add_special_tokens=False)
                mask, parts = masked(encoded.offsets, [s for s, own in zip(spans, learned, strict=True) if own])
                rows.append((len(turns), text, encoded.ids, mask, [list(p) for own in parts for p in own]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(ARROW)
            made = [pa.array(c, type=f.type) for c, f in zip(columns, ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["conv_id", *ARROW.names])

    return grouped.mapInArrow(run, T.StructType([grouped.schema["conv_id"], *FORMATTED.fields]))


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:  # noqa: B008
    """Digests of what format_conversations made, from its output alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256 (the
    texts under the mask, unescaped, one after the other), formatted_chars, n_tokens, loss_tokens.  One row for each row
    of formatted, null conv_ids and repeated rows too; empty conversations and texts give digests of nothing; texts are
    read whole; an empty table gives no rows; other columns are not read.
    """
    chosen = formatted.select("conv_id", "formatted", "loss_spans", F.size("ids").cast("long").alias("n_tokens"), F.size(F.filter("loss_mask", lambda x: x)).cast("long").alias("loss_tokens"))
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def of_row(text: str, spans: list[list[int]]) -> tuple:
        turns = template.read(text)
        loss = "".join(template.unescape(text[a:b]) for a, b in spans)
        return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of_row(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            made = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, batch.column(3), batch.column(4)], names=["conv_id", *names, "n_tokens", "loss_tokens"])

    schema = f"conv_id {chosen.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    return chosen.mapInArrow(run, schema)


def chat_sql(tricky: str, template: ChatTemplate = ChatTemplate()) -> str:  # noqa: B008
    """DuckDB SQL for the digests of read_back (without token counts) over conversations and one more, of text tricky."""
    control = "|".join(re.escape(c) for c in template.control).replace("'", "''")
    escaped = lambda x: f"length({x}) + length({x}) - length(replace({x}, '\\', '')) + len(regexp_extract_all({x}, '{control}'))"
    marks = len(template.begin) + len(template.middle) + len(template.end)
    learned = ", ".join(f"'{r}'" for r in template.learned)
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{tricky}' UNION ALL SELECT -1, 1, 'assistant', '{tricky}'),
t AS (SELECT *, {marks} + {escaped("text")} + {escaped("role")} + length(role) - length(replace(role, chr(10), '')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({learned})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN ({learned})), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
