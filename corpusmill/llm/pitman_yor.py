"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Each word is a restaurant for the words after it; all share one parent restaurant, whose base is uniform over the
vocabulary. A word's customers after a context sit at tables; each table is one customer of the parent. Gibbs sweeps
take all customers of a word out of a context and draw their number of tables anew from its conditional weights, given
the rest: the parent's probability and the context's number of tables. The probability of a token is averaged over the states after several sweeps.

Texts stay in blocks. A block asks the owners of hash ranges for counts and tables and gets them as packed arrays. A
pair that was seen once always has one table, so sweeps only move the pairs seen more often, each of them from one
block, its home. Draws come from a hash of pair and sweep: any block seats a pair alike, and so does a retried task.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.blocks import NO_ID, blocks, bucket_of, each, from_steps, slices, spread, squeezed, steps, unpacked
from corpusmill.llm.common import released, written

SWEEPS = 3
SAMPLES = 2
CONCENTRATION = 0.5
#: Customers of one dish whose tables are drawn from their exact weights.
EXACT = 512
#: Bytes of text for which one range of words or of pairs is made.
WORD_BYTES, PAIR_BYTES = 64 << 20, 16 << 20
#: Counts of one block fit in 32 bits, those of the corpus may not; a total and whether the pair is at home.
_COUNT = ("<u8", "u1")
ROWS = "kind string, bucket int, block string, blob binary"
_COLUMNS = ["kind", "bucket", "block", "blob"]
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Vocabulary(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Counted:
    """A block's tokens as numbers of its own words, its words by hash, its pairs by hash and their counts in training."""

    def __init__(self, row) -> None:
        self.ids, self.out, texts = unpacked(row)
        known = _Vocabulary({None: 0})  # the end of a text, and what stands before one
        parts = []
        for t in texts:
            ws = t.translate(_LOWER).split()
            parts.append(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)))
            parts.append(np.zeros(1, np.int64))
        self.sizes = np.array([len(p) + 1 for p in parts[::2]], np.int64)
        token = np.concatenate(parts) if parts else np.empty(0, np.int64)
        train = np.repeat(self.out == 0, self.sizes)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) if w is not None else 0x5EED for w in known), np.uint64, len(known))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.token = hashes[order], place[token]
        self.context = np.append(place[:1], self.token[:-1])[: len(token)]
        self.word_count = np.bincount(self.token, train, len(order)).astype(np.int64)
        g = _pair_hash(self.words[self.context], _mix(self.words)[self.token])
        order = np.argsort(g)
        g = g[order]
        new = np.append(True, g[1:] != g[:-1])[: len(g)]
        first = order[new]
        self.pairs, self.u, self.w = g[new], self.context[first], self.token[first]
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        self.pair_count = np.bincount(self.pair, train, len(order)).astype(np.int64)


def _pair_hash(u: np.ndarray, mixed_w: np.ndarray) -> np.ndarray:
    """Hash of a context and the word after it, from the one's hash and the other's mixed one."""
    return _mix(u * np.uint64(0x9E3779B97F4A7C15) + mixed_w)


def _words_to(owners: int, kind: str, block: str, words: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Rows that carry words, ascending by hash, and their columns to the words' owners."""
    return [(kind, b, block, squeezed(steps(words[x:y]), *[c[x:y] for c in columns])) for b, x, y in slices(bucket_of(words, owners)[0])]


def _ask(words: int, pairs: int):
    def run(frames):
        for f in frames:
            for row in each(f):
                c = _Counted(row)
                out = _words_to(words, "word", row.block, c.words, c.word_count.astype("<u4"))
                bucket, keys = bucket_of(c.pairs, pairs)
                counts = c.pair_count.astype("<u4")
                out += [("pair", words + b, row.block, squeezed(steps(keys[x:y]), counts[x:y])) for b, x, y in slices(bucket)]
                yield pd.DataFrame(out, columns=_COLUMNS)

    return run


def _count(frame: pd.DataFrame) -> pd.DataFrame:
    """Training counts of a range's words or pairs, to each block that has them; a pair's home is its first block."""
    frame = frame.sort_values("block")
    parts = [spread(b, "<u8", "<u4") for b in frame["blob"]]
    parts = [(from_steps(k), n) for k, n in parts]
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    _, of = np.unique(keys, return_inverse=True)
    total = np.bincount(of, counts).astype(np.int64)
    home = np.zeros(len(keys), bool)
    trained = np.flatnonzero(counts)
    home[trained[np.unique(of[trained], return_index=True)[1]]] = True
    ends = np.cumsum([0, *[len(p[0]) for p in parts]])
    answer = total[of].astype("<u8")
    blobs = [squeezed(answer[a:b], home[a:b].astype("u1")) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    kind, bucket = frame["kind"].iloc[0], frame["bucket"].iloc[0]
    out = pd.DataFrame({"kind": kind, "bucket": bucket, "block": frame["block"], "blob": blobs})
    facts = np.array([total.sum(), np.count_nonzero(total), np.count_nonzero(total == 1), np.count_nonzero(total == 2)], np.int64)
    return pd.concat([out, pd.DataFrame([("fact " + kind, bucket, "", squeezed(facts))], columns=_COLUMNS)])


def _joined(frame: pd.DataFrame, kind: str, *types: str) -> list[np.ndarray]:
    """The answers of one kind, in the order of their ranges, as whole arrays."""
    parts = [spread(b, *types) for b in frame[frame["kind"] == kind].sort_values("bucket")["blob"]]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t) for i, t in enumerate(types)]


def _first_state(words: int):
    """A block's counts, the pairs at home with more than one customer, and its words with their tables at home.

    Every pair at home begins with one table: it counts for its word in the parent and for its context.
    """

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return answers[_COLUMNS]
        out = []
        for row in each(block):
            c = _Counted(row)
            n_w, (n_p, at_home) = _joined(answers, "word", *_COUNT)[0], _joined(answers, "pair", *_COUNT)
            out += [("words", -1, row.block, squeezed(n_w)), ("pairs", -1, row.block, squeezed(n_p))]
            home = at_home == 1
            dish, table = (np.bincount(x[home], minlength=len(c.words)).astype("<u4") for x in (c.w, c.u))
            out += _words_to(words, "tally", row.block, c.words, dish, table)
            often = np.flatnonzero(home & (n_p > 1))
            often = often[np.lexsort((c.w[often], c.u[often]))]
            used, at = np.unique(np.concatenate([c.u[often], c.w[often]]), return_inverse=True)
            u, w = at[: len(often)].astype("<u4"), at[len(often) :].astype("<u4")
            out.append(("moved", -1, row.block, squeezed(steps(u), w, n_p[often])))
            out.append(("used", -1, row.block, squeezed(steps(c.words[used]))))
        return pd.DataFrame(out, columns=_COLUMNS)

    return run


@lru_cache(maxsize=4)
def _log_ways(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: the weight of n customers at t tables, for n up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, EXACT + 1)
    for n in range(1, EXACT):
        with np.errstate(divide="ignore"):
            joined = out[n, 1:-1] + np.log(np.maximum(n - discount * t, 0.0))
        out[n + 1, 1:-1] = np.logaddexp(joined, out[n, :-2])
    return out


def uniforms(key: np.ndarray, sweep: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) for each key in a sweep."""
    x = _mix(key ^ _mix(np.array([sweep + 1], np.uint64)))
    y = _mix(x + np.uint64(0x9E3779B97F4A7C15))
    return tuple(((v >> np.uint64(11)) + 0.5) * 2.0**-53 for v in (x, y))


def _expected(n: np.ndarray, rate: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables of many customers: tables come as by a Poisson law with a weight x for each
    customer, chosen so that n customers are expected, and are then given that n came."""
    low, high = np.zeros(len(n)), np.full(len(n), 60.0)  # -log(1 - x)
    for _ in range(60):
        middle = (low + high) / 2
        more = rate * -np.expm1(-middle) * np.exp((1 - discount) * middle) < n
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    x = -np.expm1(-low)
    mean = rate / discount * -np.expm1(-discount * low)
    spread_of = n + rate * x * x * (1 - discount) * np.exp((2 - discount) * low)
    return mean, np.maximum(mean - n * (n / spread_of), 0.0)


def seated(key: np.ndarray, sweep: int, customers: np.ndarray, rate: np.ndarray, discount: float) -> np.ndarray:
    """Tables of each dish, drawn given everything else: t with a weight of ways(n, t) * rate**t.

    Exact up to EXACT customers. Of more, EXACT are seated so, and the tables that the rest are expected to add come on
    top, with the variance that they add.
    """
    out = np.ones(len(customers))
    few = np.minimum(customers, EXACT)
    x, y = uniforms(key, sweep)
    ways, order = _log_ways(discount), np.argsort(few, kind="stable")
    edges = np.searchsorted(few[order], np.arange(2, EXACT + 2))
    for n in np.unique(few[few > 1]).tolist():
        rows = order[edges[n - 2] : edges[n - 1]]
        for part in np.array_split(rows, max(1, -(-len(rows) * n // (1 << 21)))):
            weight = ways[n, 1 : n + 1] + np.log(rate[part])[:, None] * np.arange(1, n + 1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[part] = 1 + (weight < (x[part] * weight[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        n, r = customers[many].astype(float), rate[many]
        mean, variance = _expected(n, r, discount)
        begun, begun_variance = _expected(np.full(len(many), float(EXACT)), r, discount)
        z = np.sqrt(-2 * np.log(y[many])) * np.cos(2 * np.pi * _again(y[many]))
        more = mean - begun + np.sqrt(np.maximum(variance - begun_variance, 0.0)) * z
        out[many] = np.clip(out[many] + np.rint(more), 1, n)
    return out


def _again(y: np.ndarray) -> np.ndarray:
    """Another number in (0, 1) from the low digits of one."""
    return np.mod(y * 2.0**26, 1.0)


class _Model:
    """Discounts, concentration, vocabulary, and per state the parent's customers and tables in all."""

    def __init__(self, vocabulary: int, pair_discount: float, discount: float, concentration: float) -> None:
        self.vocabulary, self.pair_discount, self.discount, self.concentration = vocabulary, pair_discount, discount, concentration
        self.totals: list[tuple[int, int]] = []

    def parent(self, state: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probability of a word."""
        all_customers, all_tables = self.totals[state]
        base = (self.concentration + self.discount * all_tables) / (self.vocabulary + 1)
        return (customers - self.discount * tables + base) / (self.concentration + all_customers)


_STATE = ("<u8", "<u8", "<u8")  # a word's customers and tables in the parent, and tables as a context


def _word_state(frame: pd.DataFrame) -> pd.DataFrame:
    """A range's words with their tallies at the start, and their answers to the blocks."""
    frame = frame.sort_values("block")
    parts = [spread(b, "<u8", "<u4", "<u4") for b in frame["blob"]]
    parts = [(from_steps(p[0]), *p[1:]) for p in parts]
    words, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    dish, table = (np.bincount(of, np.concatenate([p[i] for p in parts])).astype("<u8") for i in (1, 2))
    own = (dish > 0).astype("<u8")
    bucket = frame["bucket"].iloc[0]
    facts = np.array([dish.sum(), own.sum(), np.count_nonzero(dish == 1), np.count_nonzero(dish == 2)], np.int64)
    rows = [("state", bucket, "", squeezed(steps(words), dish, own, table)), ("fact", bucket, "", squeezed(facts))]
    return pd.DataFrame(rows, columns=_COLUMNS)


def _asked_again(words: int):
    """The words that a block's moving pairs need, to their owners."""

    def run(frames):
        for f in frames:
            out = []
            for block, blob in zip(f["block"], f["blob"], strict=True):
                out += _words_to(words, "used", block, from_steps(spread(blob, "<u8")[0]))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return run


def _look_up(states: int):
    """Owners' answers to lists of words: their numbers in each of the last ``states`` states."""

    def run(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        held = [spread(b, "<u8", *_STATE) for b in known.sort_values("kind")["blob"]][-states:]
        known_words = from_steps(held[0][0]) if held else np.empty(0, np.uint64)
        out = []
        for kind, bucket, block, blob in asked[_COLUMNS].itertuples(index=False):
            words = from_steps(spread(blob, "<u8", *(("<u4", "<u4") if kind == "tally" else ()))[0])
            at = np.searchsorted(known_words, words)
            out.append(("answer", bucket, block, squeezed(*[x[at] for h in held for x in h[1:]])))
        return pd.DataFrame(out, columns=_COLUMNS)

    return run


def _sweep(model: _Model, state: int, words: int):
    """Seat the moving pairs of a block again; what changed against one table each, to the words' owners."""

    def run(moved: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for block in moved["block"].unique():
            mine = moved[moved["block"] == block]
            u, w, n = _joined(mine, "moved", "<u4", "<u4", "<u8")
            u, used = from_steps(u), from_steps(_joined(mine, "used", "<u8")[0])
            customers, tables, as_context = _joined(answers, "answer", *_STATE)
            rate = (model.concentration + model.pair_discount * as_context[u]) * model.parent(state, customers, tables)[w]
            more = seated(_pair_hash(used[u], _mix(used[w])), state, n.astype(np.int64), rate, model.pair_discount) - 1
            dish, table = (np.bincount(x, more, len(used)).astype("<u8") for x in (w, u))
            out += _words_to(words, "more", block, used, dish, table)
        return pd.DataFrame(out, columns=_COLUMNS)

    return run


def _next_state(model: _Model, state: int):
    """A range's words after a sweep: the first tallies and what the blocks add; then the parent's tables anew."""

    def run(known: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        words, dish, _, table = spread(known[known["kind"] == "state"]["blob"].iloc[0], "<u8", *_STATE)
        words = from_steps(words)
        dish, table = dish.astype(np.int64), table.astype(np.int64)
        for blob in more["blob"]:
            used, d, t = spread(blob, "<u8", "<u8", "<u8")
            at = np.searchsorted(words, from_steps(used))
            np.add.at(dish, at, d.astype(np.int64))
            np.add.at(table, at, t.astype(np.int64))
        base = (model.concentration + model.discount * model.totals[state][1]) / (model.vocabulary + 1)
        own = np.where(dish > 0, seated(words, state + 500, dish, np.full(len(words), base), model.discount), 0).astype("<u8")
        bucket = known["bucket"].iloc[0]
        rows = [(f"state {state + 1}", bucket, "", squeezed(steps(words), dish.astype("<u8"), own, table.astype("<u8")))]
        facts = np.array([dish.sum(), own.sum(), 0, 0], np.int64)
        return pd.DataFrame([*rows, ("fact", bucket, "", squeezed(facts))], columns=_COLUMNS)

    return run


def _score(model: _Model, first: int, samples: int, train_tokens: int):
    """Each document's tokens, known tokens, base score and score."""

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in each(block):
            c = _Counted(row)
            n_w, n_p = _joined(answers, "words", "<u8")[0].astype(np.int64), _joined(answers, "pairs", "<u8")[0].astype(np.int64)
            states = _joined(answers, "answer", *_STATE * (samples + 1))
            states = [[x.astype(float) for x in states[3 * k : 3 * k + 3]] for k in range(samples + 1)]
            mean = np.zeros(len(c.pairs))
            for k in range(samples):
                customers, tables, as_context = states[k]
                rate = (model.concentration + model.pair_discount * as_context[c.u]) * model.parent(first + k, customers, tables)[c.w]
                t = np.where(n_p > 0, seated(c.pairs, first + k, n_p, rate, model.pair_discount), 0)
                customers, tables, as_context = states[k + 1]
                above = model.parent(first + k + 1, customers, tables)[c.w]
                held = n_p - model.pair_discount * t + (model.concentration + model.pair_discount * as_context[c.u]) * above
                mean += held / (model.concentration + n_w[c.u])
            score = np.log10(mean / samples)[c.pair]
            base = np.log10((n_w + 1) / (train_tokens + model.vocabulary + 1))[c.token]
            ends = np.cumsum(c.sizes)
            sums = [np.add.reduceat(x, ends - c.sizes) for x in ((n_w > 0)[c.token].astype(np.int64), base, score)]
            out.append(pd.DataFrame({"id": c.ids, "out": c.out.astype(bool), "n_tokens": c.sizes, "n_known": sums[0], "base_score": sums[1], "score": sums[2]}))
        return pd.concat(out)

    return run


def _facts(rows: DataFrame, kind: str) -> np.ndarray:
    """Sums of the four facts of all ranges: one small row for each."""
    found = [spread(bytes(r["blob"]), "<i8")[0] for r in rows.where(F.col("kind") == kind).select("blob").collect()]
    return np.sum(found, axis=0) if found else np.zeros(4, np.int64)


def pitman_yor_scores(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text: str = "text",
    sweeps: int = SWEEPS,
    samples: int = SAMPLES,
    concentration: float = CONCENTRATION,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row, learned from rows not held out.

    Tokens are the words (runs other than space and \\x09-\\x0D, A-Z lower-cased) and one end of the text; the first
    word's context is the end. base_score: the add-one unigram's log10 probability, score: the model's, averaged over
    the states after the last ``samples`` of ``sweeps`` sweeps. Null and empty texts are their end alone; repeated
    rows count as often as they come; a null id stays null; other columns aren't read. Without a training row every
    word has the base probability. The discount of a level is n1 / (n1 + 2 n2) of its customers per dish.

    Words are compared by 64-bit hash, pairs by 40 bits within their range, whose size doesn't grow with the corpus.
    """
    spark = docs.sparkSession
    samples = min(samples, sweeps)
    held = blocks(docs, id_col, text, F.coalesce(held_out, F.lit(False)))
    total = held.agg(F.sum("size")).first()[0] or 0
    n_words, n_pairs = max(1, -(-total // WORD_BYTES)), max(1, -(-total // PAIR_BYTES))

    asked = held.mapInPandas(_ask(n_words, n_pairs), ROWS)
    counted = asked.groupBy("bucket").applyInPandas(_count, ROWS)
    first = written(held.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(_first_state(n_words), ROWS), "counts", "uncompressed")
    del asked, counted
    released(spark)
    word_facts, pair_facts = _facts(first, "fact word"), _facts(first, "fact pair")
    tally = first.where("kind = 'tally'")
    state = written(tally.groupBy("bucket").applyInPandas(_word_state, ROWS), "words", "uncompressed")
    facts = _facts(state, "fact")
    discount = lambda n: min(0.95, max(0.05, float(n[2]) / max(1.0, float(n[2] + 2 * n[3]))))
    model = _Model(int(word_facts[1]), discount(pair_facts), discount(facts), concentration)
    model.totals.append((int(facts[0]), int(facts[1])))
    begin = state.where("kind = 'state'")
    states = [begin]
    used = first.where("kind = 'used'").mapInPandas(_asked_again(n_words), ROWS)
    moved = first.where("kind in ('moved', 'used')")
    for k in range(sweeps):
        answers = states[-1].groupBy("bucket").cogroup(used.groupBy("bucket")).applyInPandas(_look_up(1), ROWS)
        more = moved.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_sweep(model, k, n_words), ROWS)
        after = written(begin.groupBy("bucket").cogroup(more.groupBy("bucket")).applyInPandas(_next_state(model, k), ROWS), f"sweep-{k}", "uncompressed")
        model.totals.append(tuple(int(x) for x in _facts(after, "fact")[:2]))
        states.append(after.where("kind <> 'fact'"))
        del answers, more, after
        released(spark)
    kept = states[-samples - 1]
    for s in states[len(states) - samples :]:
        kept = kept.unionByName(s)
    answers = kept.groupBy("bucket").cogroup(tally.groupBy("bucket")).applyInPandas(_look_up(samples + 1), ROWS)
    answers = answers.unionByName(first.where("kind in ('words', 'pairs')"))
    schema = "id long, out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = held.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(model, sweeps - samples, samples, int(word_facts[0])), schema)
    back = F.when(F.col("id") != NO_ID, F.col("id")).cast(docs.schema[id_col].dataType)
    return scored.select(back.alias(id_col), F.col("out").alias("held_out"), "n_tokens", "n_known", F.lit(int(word_facts[0])).cast("long").alias("train_tokens"), "base_score", "score")
