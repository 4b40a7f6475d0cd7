"""Nearest text by edit distance, exact within a share of edits, by tiles of lengths.

Texts are cut into classes of length; neighbouring classes make units of known texts, and a unit
meets every new text whose length fits, a lot of them at a time. Texts travel as packed tables.

Within a tile a known text of ``n`` characters, of which at most ``k`` may be edited, signs with
``k + 1`` disjoint pieces, the rarest it has. Edits destroy ``k`` of them at most, so one piece at
least lies unchanged in any text within reach, near its old place.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

UNIT = 16_000_000, 64_000_000  # weight of the known texts of a tile, at least and at most, and of its new ones
LOT = 8_000_000, 96_000_000
TILES_WANTED = 16  # as many keep the cores busy; more of them only move texts more often
EACH = 64  # weight of a text besides its characters
PACK = 2_000_000  # weight at which packed texts are sent, and of what all packs of a task may hold
HELD = 48_000_000
RATIO = 1.03  # lengths of one class
CHUNK = 1_000_000  # characters hashed at a time
HITS = 2_000_000  # places looked at together
PLACES = 8_000_000  # counts of profiles compared together
LONGEST = 8  # characters of a piece


def _class(n):
    return int(math.log(max(n, 1)) / math.log(RATIO))


def _most(n, slack):
    """Edits between a text of ``n`` characters and any text within reach, at most."""
    return int(n * slack / (1 - slack) + 1e-6)


# --- plan ---


def _plan(known, new, slack):
    """Unit of every class of length: (first unit, number of units) by class, and the lots of every unit."""
    bounded = lambda n, sizes: min(max(n, sizes[0]), sizes[1])
    unit = bounded(sum(known.values()) / 4, UNIT)
    top = max([*known, *new], default=0) + 2
    first, parts, meets, at, run = np.zeros(top, int), np.ones(top, int), [], 0, []
    reach = math.ceil(-math.log(1 - slack) / math.log(RATIO)) + 1 if slack else 1

    def close():
        nonlocal at, run
        total = sum(known.get(c, 0) for c in run)
        n = max(1, math.ceil(total / unit))
        met = sum(new.get(c, 0) for c in range(run[0] - reach, run[-1] + reach + 1))
        first[run], parts[run] = at, n
        meets.extend([met] * n)
        at, run = at + n, []

    for c in range(top):
        if run and sum(known.get(x, 0) for x in [*run, c]) > unit:
            close()
        run.append(c)
    close()
    lot = bounded(sum(meets) / TILES_WANTED, LOT)
    return first, parts, [max(1, math.ceil(met / lot)) for met in meets]


def _weights(new, known):
    """Weight of the texts by class of length, of both sides."""
    n = F.length("text")
    cls = F.floor(F.log(F.greatest(n, F.lit(1))) / math.log(RATIO)).cast("int")
    side = lambda df, name: df.select(F.lit(name).alias("side"), cls.alias("cls"), (n + EACH).alias("w"))
    rows = side(known, "known").unionByName(side(new, "new")).groupBy("side", "cls").agg(F.sum("w").alias("w")).collect()
    return [{r["cls"]: r["w"] for r in rows if r["side"] == s} for s in ("known", "new")]


# --- packing ---


def _body(table):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    raw = sink.getvalue()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=9).compress(raw, asbytes=True)


def _table(body):
    raw = pa.Codec("zstd").decompress(body[8:], int.from_bytes(body[:8], "little"))
    return pa.ipc.open_stream(raw).read_all()


ROW = "unit int, lot int, known boolean, body binary"
TILE = pa.schema([("unit", pa.int32()), ("lot", pa.int32()), ("known", pa.bool_()), ("body", pa.binary())])


def _packer(plan, slack, kinds=None):
    """Texts by tile, packed, known ones with labels of ``kinds``.

    Where a text goes depends on itself only, so a task that runs again sends the same.
    """
    first, parts, lots = plan
    known, columns = kinds is not None, ["text", "label"] if kinds is not None else ["text"]
    last = len(first) - 1

    def homes(text):
        n, mark = len(text), zlib.crc32(text.encode())
        if known:
            c = min(_class(n), last)
            return [(int(first[c] + mark % parts[c]), -1)]
        low, high = min(_class(n * (1 - slack) - 1e-6), last), min(_class(n / (1 - slack) + 1e-6), last)
        return [(u, mark % lots[u]) for u in range(int(first[low]), int(first[high] + parts[high]))]

    def run(batches):
        held, size, total = {}, {}, 0

        def send(keys):
            for unit, lot in keys:
                rows = [*held.pop((unit, lot))]
                size.pop((unit, lot))
                values = [[r[c] for r in rows] for c in range(len(columns))]
                body = _body(pa.table([pa.array(v, kinds.field(c).type if known else pa.string()) for c, v in zip(columns, values)], columns))
                for each in range(lots[unit]) if known else [lot]:
                    yield pa.RecordBatch.from_pydict(
                        {"unit": [unit], "lot": [each], "known": [known], "body": [body]}, schema=TILE)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                text = row[0]
                for key in homes(text):
                    group = held.setdefault(key, {})
                    if row not in group:  # copies travel once
                        group[row] = None
                        size[key] = size.get(key, 0) + len(text) + EACH
                        total += len(text) + EACH
                        if size[key] > PACK:
                            total -= size[key]
                            yield from send([key])
                if total > HELD:
                    yield from send([*held])
                    total = 0
        yield from send([*held])

    return run


# --- texts as numbers ---


def _flat(texts):
    """Code points of the texts in a row, their lengths and starts."""
    x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    return x, n, np.cumsum(n) - n


def _grams(x, q):
    """Hash of the ``q`` characters from every place on."""
    h = np.zeros(max(0, len(x) - q + 1), np.uint64)
    for j in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += x[j:len(x) - q + 1 + j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _counted(sizes):
    """0, 1, ... within every group of so many."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _kind(n):
    """Characters of the grams and number of bins (as a power of two) that tell texts of this length apart.

    Long texts of one language hold much the same 3-grams, and bins must not fill up.
    """
    size = np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    return np.where(n < 1024, 3, 5), np.where(n < 1024, size, size + 2)


def _profiles(texts, q, bins):
    """Counts of hashed grams; an edit moves ``2 * q`` of them at most, and neither bins nor a ceiling add to that."""
    out = np.zeros((len(texts), bins), np.uint8)
    for a, b in _chunks(texts):
        x, n, at = _flat(texts[a:b])
        m = np.maximum(n - q + 1, 0)
        owner = np.repeat(np.arange(b - a), m)
        if not len(owner):
            continue
        h = (_grams(x, q)[np.repeat(at, m) + _counted(m)] & np.uint64(bins - 1)).astype(np.int64)
        step = max(1, 4_000_000 // bins)  # texts counted together
        for i in range(0, b - a, step):
            k = min(step, b - a - i)
            l, r = np.searchsorted(owner, [i, i + k])
            c = np.bincount((owner[l:r] - i) * bins + h[l:r], minlength=k * bins)
            out[a + i:a + i + k] = np.minimum(c, 255).reshape(k, bins)
    return out


def _chunks(texts):
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size > CHUNK:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


class Block:
    """Known texts of a tile with the pieces they sign with."""

    COUNTERS = 1 << 22

    def __init__(self, texts, slack):
        self.texts, self.slack = texts, slack
        self.rows = {t: i for i, t in enumerate(texts)}
        self.n = np.fromiter(map(len, texts), np.int64, len(texts))
        grams, bins = _kind(self.n)
        self.kind = bins * 8 + grams
        self.line, self.profiles = np.zeros(len(texts), np.int64), {}
        for kind in np.unique(self.kind):
            own = np.flatnonzero(self.kind == kind)
            self.line[own] = np.arange(len(own))
            self.profiles[int(kind)] = _profiles([texts[i] for i in own], int(kind % 8), 1 << int(kind // 8))
        found = {}
        common = {}
        for a, b in _chunks(texts):
            x, n, at = _flat(texts[a:b])
            k = (n * slack / (1 - slack) + 1e-6).astype(np.int64)
            size = np.minimum(n // (k + 1), LONGEST)
            for q in np.unique(size[k > 0]):
                own = np.flatnonzero((size == q) & (k > 0))
                h = _grams(x, int(q))
                if q not in common:  # counts of one chunk only steer which pieces are taken
                    common[q] = np.bincount((h & np.uint64(self.COUNTERS - 1)).astype(np.int64), minlength=self.COUNTERS)
                m = n[own] // q
                who, spot = np.repeat(own, m), _counted(m) * q
                sig = h[at[who] + spot]
                order = np.lexsort((common[q][(sig & np.uint64(self.COUNTERS - 1)).astype(np.int64)], who))
                taken = order[_counted(m) <= k[who[order]]]
                found.setdefault(int(q), []).append((sig[taken], (who[taken] + a).astype(np.int32), spot[taken].astype(np.int32)))
        del common
        self.pieces = {}
        for q in [*found]:
            sig, who, spot = (np.concatenate(c) for c in zip(*found.pop(q)))
            order = np.argsort(sig, kind="stable")
            sig, who, spot = sig[order], who[order], spot[order]
            starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            seen = np.zeros(1 << 24, bool)
            seen[(sig[starts] >> np.uint64(40)).astype(np.int64)] = True
            ends = np.r_[starts[1:], len(sig)]
            lengths = self.n[who]
            reach = lengths.min() * (1 - slack) - 1e-6, lengths.max() / (1 - slack) + 1e-6
            self.pieces[q] = sig[starts], starts, ends - starts, who, spot, seen, reach

    def pairs(self, texts):
        """(new, known) positions of texts that share a piece near its place, as sorted numbers new * known + known."""
        x, n, at = _flat(texts)
        out = []
        for q, (sig, starts, sizes, who, spot, seen, reach) in self.pieces.items():
            m = np.where((n >= reach[0]) & (n <= reach[1]), np.maximum(n - q + 1, 0), 0)
            if not m.any():
                continue
            new, place = np.repeat(np.arange(len(n)), m), _counted(m)
            h = _grams(x, q)[at[new] + place]
            likely = np.flatnonzero(seen[(h >> np.uint64(40)).astype(np.int64)])
            h = h[likely]
            key = np.minimum(np.searchsorted(sig, h), len(sig) - 1)
            hit = sig[key] == h
            new, place, key = new[likely[hit]], place[likely[hit]], key[hit]
            ends = np.cumsum(sizes[key])
            a = 0
            while a < len(key):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HITS, "right")))
                c = sizes[key[a:b]]
                row = np.repeat(starts[key[a:b]], c) + _counted(c)
                i, j = np.repeat(new[a:b], c), who[row]
                longer = np.maximum(n[i], self.n[j])
                left = np.repeat(place[a:b], c) - spot[row]
                # what stands before the piece and what stands after it each need their edits
                near = np.abs(left) + np.abs(n[i] - self.n[j] - left) <= longer * self.slack + 1e-9
                out.append(np.unique(i[near] * len(self.n) + j[near]))
                a = b
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def nearest(self, texts):
        """(position in texts, position of the nearest known text, score) for texts that have one within reach."""
        found = []
        asked = []
        for i, t in enumerate(texts):
            if t in self.rows:
                found.append((i, self.rows[t], 100.0))
            elif _most(len(t), self.slack) and self.pieces:
                asked.append(i)
        left = [texts[i] for i in asked]
        for a, b in _chunks(left):
            part = left[a:b]
            i, j = np.divmod(self.pairs(part), max(1, len(self.n)))
            n = np.fromiter(map(len, part), np.int64, len(part))
            kept = []
            for kind, profiles in self.profiles.items():
                own = np.flatnonzero(self.kind[j] == kind)
                if not len(own):
                    continue
                met, line = np.unique(i[own], return_inverse=True)
                mine = _profiles([part[x] for x in met], kind % 8, 1 << kind // 8)
                step = max(1, PLACES >> kind // 8)  # pairs compared together
                for s in range(0, len(own), step):
                    new, old = i[own[s:s + step]], j[own[s:s + step]]
                    apart = mine[line[s:s + step]].astype(np.int16)
                    apart -= profiles[self.line[old]]
                    moved = np.abs(apart, out=apart).sum(axis=1, dtype=np.int64)
                    longer = np.maximum(n[new], self.n[old])
                    least = np.maximum(-(-moved // (2 * (kind % 8))), np.abs(n[new] - self.n[old]))
                    near = least <= longer * self.slack + 1e-9
                    kept.append((new[near], old[near], least[near] / longer[near]))
            if not kept:
                continue
            i, j, share = (np.concatenate(c) for c in zip(*kept))
            order = np.lexsort((share, i))
            i, j, share = i[order].tolist(), j[order].tolist(), share[order].tolist()
            best = {}
            for new, old, least in zip(i, j, share):
                text, match = part[new], self.texts[old]
                longer = max(len(text), len(match))
                top = best.get(new)
                if top and least > top[2]:
                    continue
                edits = distance(text, match, int((top[2] if top else self.slack) * longer + 1e-9))
                if edits is not None:
                    key = (-((longer - edits) / longer * 100.0), match, edits / longer, old)
                    best[new] = min(top, key) if top else key
            found += [(asked[a + new], old, -score) for new, (score, _, _, old) in best.items()]
        return found


def distance(a, b, most):
    """Edit distance of two texts, None above ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    low, high = 0, min(len(a), len(b))
    while low < high:  # common ends need no edits
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid:] == b[len(b) - mid:] else (low, mid - 1)
    a, b = a[:len(a) - low], b[:len(b) - low]
    if not a or not b:
        return len(a) + len(b)
    # every alignment crosses the corner of two heads of one length, at the cost of the difference in lengths at most
    apart = abs(len(a) - len(b))
    head = 2 * (most + apart) + 32
    if 3 * head < min(len(a), len(b)) and _table_edits(a[:head], b[:head], most + apart) is None:
        return None
    return _table_edits(a, b, most)


def _table_edits(a, b, most):
    # a column of the edit table is a pair of bit vectors
    at = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, edits, left = full, 0, len(a), len(b)
    for c in b:
        same = at.get(c, 0)
        vertical = same | down
        level = (((same & up) + up) ^ up) | same
        rise, fall = (down | ~(level | up)) & full, up & level
        if rise & top:
            edits += 1
        elif fall & top:
            edits -= 1
        left -= 1
        if edits - left > most:
            return None
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = (fall | ~(vertical | rise)) & full, rise & vertical
    return edits if edits <= most else None


# --- join ---


def nearest_texts(new, known, slack):
    """(text, match, label, score) of new texts that have a known one within ``slack``: best score, then smallest match and label.

    ``new`` has a column text, ``known`` text and label; texts and rows may repeat, null texts take no part.
    """
    new, known = (df.filter(F.col("text").isNotNull()) for df in (new, known))
    kinds = known.select("text", "label").limit(0).toArrow().schema
    plan = _plan(*_weights(new, known), slack)
    tiles = known.select("text", "label").mapInArrow(_packer(plan, slack, kinds), ROW).unionByName(
        new.select("text").mapInArrow(_packer(plan, slack), ROW))

    def run(table):
        sides = table.column("known").to_pylist()
        packs = lambda known: (_table(body.as_py()) for body, side in zip(table.column("body"), sides) if side == known)
        rows = pa.concat_tables([kinds.empty_table().select(["text", "label"]), *packs(True)]).group_by(["text", "label"]).aggregate([])
        labels, places = rows.column("label"), {}
        for i, t in enumerate(rows.column("text").to_pylist()):
            places.setdefault(t, []).append(i)
        block = Block([*places], slack)
        texts, matches, at, scores = [], [], [], []
        for pack in packs(False):
            asked = pack.column("text").to_pylist()
            for own, old, score in block.nearest(asked):
                match = block.texts[old]
                for row in places[match]:  # a row for every label it has
                    texts.append(asked[own])
                    matches.append(match)
                    at.append(row)
                    scores.append(score)
        return pa.table({
            "text": pa.array(texts, pa.string()), "match": pa.array(matches, pa.string()),
            "label": labels.take(pa.array(at, pa.int64())), "score": pa.array(scores, pa.float64())})

    schema = StructType([
        StructField("text", StringType()), StructField("match", StringType()), StructField("label", known.schema["label"].dataType),
        StructField("score", DoubleType())])
    found = tiles.groupBy("unit", "lot").applyInArrow(run, schema)
    # min() of labels passes over nulls, that of a struct does not
    order = F.struct((-F.col("score")).alias("neg"), F.col("match"), F.col("label").isNull().alias("none"), F.col("label"))
    best = found.groupBy("text").agg(F.min(order).alias("b"))
    return best.select("text", F.col("b.match").alias("match"), F.col("b.label").alias("label"), (-F.col("b.neg")).alias("score"))
