"""Chat formatting by a finite-state machine over roles and a declarative template.

The template names for each role the marks around its text and whether the text bears
loss, and the roles that may follow each role. Turns are sorted by conversation and turn
within partitions and streamed: the machine keeps one state, so a conversation of any
length needs no more memory than one turn. Each turn gives its segments (text, loss flag)
and whether the order was valid so far.

Control strings inside texts are escaped by a backslash, and so are backslashes, so the
formatted text can be read back exactly; ``read_back`` does it from the segments alone.

A null text is an empty one. Turns of one number are ordered by role and text; repeated
rows are turns of their own. A role the template doesn't name, null included, is formatted
with the marks of ``other``, which carry the role's name, and makes the order invalid.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from emberlog.llm.base import extend, query, table

TEMPLATE = {
    "marks": {
        "system": {"open": "<<SYS>>", "close": "<</SYS>>", "loss": False},
        "user": {"open": "[INST]", "close": "[/INST]", "loss": False},
        "assistant": {"open": "<s>", "close": "</s>", "loss": True},
    },
    "other": {"open": "<<ROLE>>", "named": "<<TEXT>>", "close": "<</ROLE>>", "loss": False},
    "follows": {None: ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "ends": ["assistant"],
}


class Format:
    """The template with its machine, escapes and reader."""

    def __init__(self, template):
        self.marks, self.other, self.follows = template["marks"], template["other"], template["follows"]
        controls = {m[k] for m in [*self.marks.values(), self.other] for k in ("open", "close", "named") if k in m}
        either = "|".join(map(re.escape, sorted(controls, key=len, reverse=True)))
        self.special = re.compile(rf"\\|{either}")
        self.scanner = re.compile(rf"\\(\\|{either})|({either})")

    def escape(self, text):
        return self.special.sub(lambda m: "\\" + m[0], text)

    def step(self, state, role):
        """Next state of the machine; False once the order was broken."""
        return role if state is not False and role in self.follows.get(state, ()) else False

    def turn(self, role, text):
        """Segments (text, loss) of one turn."""
        if role in self.marks:
            m = self.marks[role]
            return [(m["open"], False), (self.escape(text), m["loss"]), (m["close"], False)]
        m = self.other
        return [(m["open"] + self.escape(role or "") + m["named"], False), (self.escape(text), m["loss"]), (m["close"], False)]

    def read(self, text, loss):
        """(role, text, loss text) of the turn in ``text``; ``loss`` flags each of its characters' segments.

        ``loss`` is a list of (start, end) of the segments that bear loss.
        """
        roles = {m["open"]: r for r, m in self.marks.items()}
        role, plain, trained, at = None, [], [], 0

        def take(piece, start):
            plain.append(piece)
            if any(a <= start < b for a, b in loss):
                trained.append(piece)

        name = None
        for m in self.scanner.finditer(text):
            if m.start() > at:
                take(text[at : m.start()], at)
            if m[1] is not None:
                take(m[1], m.start())
            elif m[2] in roles:
                role = roles[m[2]]
            elif m[2] == self.other["named"]:
                name, plain, trained = "".join(plain), [], []
            at = m.end()
        return role if name is None else name, "".join(plain), "".join(trained)


def format_turns(turns, conv="conv_id", turn="turn", role="role", text="text", template=TEMPLATE):
    """One row per turn, in order: ``conv``, ``seq``, ``segments`` (text, loss), ``valid`` so far."""
    rows = turns.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.col(role).alias("_r"), F.col(text).alias("_x"))
    rows = rows.repartition("_c").sortWithinPartitions("_c", "_t", "_r", "_x").select("_c", "_r", "_x")
    segment = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
    schema = extend(
        rows.select(F.col("_c").alias(conv)).schema, "seq long, segments array<struct<text:string,loss:boolean>>, valid boolean")

    def run(batches):
        form, current, seq, state, begun = Format(template), None, 0, None, False
        for b in batches:
            seqs, segments, valid = [], [], []
            for c, r, x in zip(b.column("_c").to_pylist(), b.column("_r").to_pylist(), b.column("_x").to_pylist()):
                if not begun or c != current:
                    current, seq, state, begun = c, 0, None, True
                state = form.step(state, r)
                seqs.append(seq)
                segments.append([{"text": t, "loss": f} for t, f in form.turn(r, x or "")])
                valid.append(state is not False)
                seq += 1
            yield pa.RecordBatch.from_arrays(
                [b.column("_c"), pa.array(seqs, pa.int64()), pa.array(segments, segment), pa.array(valid)], names=schema.names)

    return rows.mapInArrow(run, schema)


def read_back(formatted, conv="conv_id", template=TEMPLATE):
    """Per conversation the digests of what the formatted segments say. Keeps the order of ``format_turns``.

    A conversation's rows stand together, so only running digests are kept.
    """
    rows = formatted.select(F.col(conv).alias("_c"), "segments", "valid")
    schema = extend(
        rows.select(F.col("_c").alias(conv)).schema,
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")

    def run(batches):
        form, begun, current, kind = Format(template), False, None, None
        done = []

        def fresh():
            return {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "valid": True}

        def flush():
            rows, done[:] = list(done), []
            return pa.RecordBatch.from_arrays([
                pa.array([c for c, _ in rows], kind), pa.array([h["n"] for _, h in rows], pa.int64()),
                pa.array([h["turns"].hexdigest() for _, h in rows]), pa.array([h["chars"] for _, h in rows], pa.int64()),
                pa.array([h["loss"].hexdigest() for _, h in rows]), pa.array([h["size"] for _, h in rows], pa.int64()),
                pa.array([h["valid"] for _, h in rows], pa.bool_())], names=schema.names)

        held = fresh()
        for b in batches:
            kind = b.column("_c").type
            for c, segments, valid in zip(b.column("_c").to_pylist(), b.column("segments").to_pylist(), b.column("valid").to_pylist()):
                if begun and c != current:
                    done.append((current, held))
                    held = fresh()
                current, begun = c, True
                whole, loss = "", []
                for s in segments:
                    if s["loss"]:
                        loss.append((len(whole), len(whole) + len(s["text"])))
                    whole += s["text"]
                role, text, trained = form.read(whole, loss)
                held["n"] += 1
                held["turns"].update(f"{role}\n{text}\n".encode())
                held["chars"] += len(trained)
                held["loss"].update(trained.encode())
                held["size"] += len(whole)
                held["valid"] &= valid
            if done:
                yield flush()
        if begun:
            done.append((current, held))
            yield flush()

    return rows.mapInArrow(run, schema)


@query("op7_chat_format")
def op7_chat_format(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    read = read_back(format_turns(turns.unionByName(own)))
    return read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", F.col("valid").alias("valid_order"))
