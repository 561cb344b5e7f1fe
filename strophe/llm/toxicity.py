"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols by a lexicon and the symbols of a clause run through one
transducer, the composition of

* negation: an insult or a harming verb within three words of a negation is
  marked negated;
* report: one within four words of a verb of speech is marked reported;
* threat: a harming verb within three words of an intent (will, going to) or at
  a clause's start, and then someone it is aimed at within three words, if no
  particle follows (kill them off);
* address: an insult right after someone addressed, or within four words of a
  verb of being after them (you are such a ...), if no definite article stands
  between.  Any other insult is literal after an article, a word of degree or a
  verb of being (the trash, a clown, is stupid), an opening as the first word
  of its clause (garbage is ...), else loose; learned slurs, which labels know
  from toxic texts only, are loose everywhere;
* vocative: an opening or loose insult in a clause of at most two words, unless
  the opening begins a compound (garbage collection);
* clause: a loose insult after another or an opening in one clause is a run,
  and a clause that has loose insults is one bare clause.

A word by itself weighs nothing: literal words and openings have no weight, and
neither has a text's first bare clause.  A text's score is a logistic unit over
the weights of its patterns (``log2(1 + n)`` of n equal ones, ``log2(n)`` of
bare clauses); the weights are fitted to labels, and stay near their defaults
where no labelled text has the pattern.

The lexicon is hand-written (``SEED``).  Words and stems (``stem*``, the first
characters of words) that labelled rows support are added as a class of their
own: ``support`` different texts have it, or three of which two have it twice,
``purity`` of them toxic, and it is taken only while it explains ``gain`` toxic
texts that no word before does (of the ``most_words`` best of them).  Learning
takes a hashed sample of about ``per_label`` rows a label.

Defined cases: null and empty texts have no clause and get the score of texts
without a pattern; without labels of both kinds the seed lexicon and default
weights are used; a null id is a training row (``held_out`` is false); repeated
rows get equal scores; columns other than id, text and (to learn) label are not
read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm._learn import sample_labelled
from strophe.llm._text import LOWER, add_columns, blocks, bytes_of, checkpoint, held_out, words

OTHER, END = "other", "end"
INSULT, SLUR, HARM, INTENT, TARGET, BEING, DEGREE, DEFINITE, NOT, REPORT, PARTICLE = "insult", "slur", "harm", "intent", "target", "being", "degree", "definite", "not", "report", "particle"
CORE = (INSULT, SLUR, HARM)

#: Words of each class, in English, German, French and Spanish; slurs are learned.
SEED = {
    INSULT: """idiot idiots moron morons loser losers scum clown clowns stupid trash garbage worthless pathetic disgusting dumb
        imbecile fool bastard jerk creep pig vermin filth coward freak cretin dimwit halfwit scumbag lowlife degenerate parasite
        repulsive despicable contemptible brainless spineless
        dummkopf trottel abschaum idiotisch versager drecksack schwachkopf widerlich wertlos
        imbécile crétin abruti connard ordure minable dégoûtant salaud raclure débile
        imbécil estúpido estúpida basura escoria inútil patético asqueroso idiota cretino payaso""",
    SLUR: "",
    HARM: """kill hurt destroy beat punch stab shoot strangle smash crush attack murder burn
        töten umbringen schlagen vernichten tuer frapper détruire écraser matar golpear destruir""",
    INTENT: "will ll gonna going shall werde werden wird vais va allons voy vamos",
    TARGET: "you your yours he she they him her them du dich dir sie euch tu toi vous te ti usted ustedes",
    BEING: "are re is s were was be being bist seid sind ist êtes est sont eres son sois",
    DEGREE: "a an such so really total complete absolute little nothing but just very ein eine so un une tellement tan muy",
    DEFINITE: "the this that these those der die das den dem le la les el los las",
    NOT: "not never no isn aren nicht kein keine nie pas jamais nunca jamás",
    PARTICLE: "off",
    REPORT: "said says say claimed called reported wrote quoted sagte sagt behauptete dit disait dijo dice",
}
SYMBOLS = (OTHER, END, *SEED)

PATTERNS = ("address", "vocative", "threat", "run", "bare")
#: Weights of patterns, plain, negated and reported, and the constant.
WEIGHTS = {"constant": -4.0} | {p + m: w * f for p, w in zip(PATTERNS, (5.0, 3.0, 5.0, 1.5, 1.0), strict=True) for m, f in (("", 1.0), ("-", 0.1), ('"', 0.3))}
FEATURES = tuple(WEIGHTS)
BARE = tuple(f for f in FEATURES if f.startswith("bare"))


class Fst:
    """A deterministic transducer: ``move(state, symbol)`` gives the next state
    and the symbols put out."""

    def __init__(self, start, move):
        self.start, self.move = start, move
        self.known: dict = {}

    def step(self, state, symbol) -> tuple:
        at = (state, symbol)
        if at not in self.known:
            self.known[at] = self.move(state, symbol)
        return self.known[at]

    def then(self, other: Fst) -> Fst:
        """The composition: what this one puts out goes into ``other``.  Its
        states are pairs, made as they are reached and kept."""
        return Fst((self.start, other.start), _Pair(self, other))

    def run(self, symbols) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            state, put = self.step(state, s)
            out.extend(put)
        return out

    def __getstate__(self):
        return {"start": self.start, "move": self.move, "known": {}}


class _Pair:
    def __init__(self, a: Fst, b: Fst):
        self.a, self.b = a, b

    def __call__(self, state, symbol) -> tuple:
        p, put = self.a.step(state[0], symbol)
        q, out = state[1], []
        for s in put:
            q, more = self.b.step(q, s)
            out.extend(more)
        return (p, q), tuple(out)


def _kind(s: str) -> tuple[str, str]:
    """A symbol and its mark: negated (-) or reported (")."""
    return (s[:-1], s[-1]) if s[-1] in "-\"" else (s, "")


class _Marker:
    def __init__(self, sign: str, mark: str, reach: int):
        self.sign, self.mark, self.reach = sign, mark, reach

    def __call__(self, left, s):
        if s == self.sign:
            return self.reach, (s,)
        return max(0, left - 1), (s + self.mark if left and s in CORE else s,)


def _threat(state, s):
    """state: words left for a harming verb, its mark, words left for a target,
    and the mark of a threat that waits for the next word."""
    ready, mark, aim, waits = state
    kind, own = _kind(s)
    said = ("threat" + waits,) if waits is not None and kind != PARTICLE else ()
    if kind == PARTICLE:
        s = OTHER
    if kind == HARM:
        return ((max(0, ready - 1), own, 3, None) if ready else (0, mark, max(0, aim - 1), None)), (*said, OTHER)
    if kind == TARGET and aim:
        return (max(0, ready - 1), "", 0, mark), (*said, s)
    return (3 if s == INTENT else max(0, ready - 1), mark if aim > 1 else "", max(0, aim - 1), None), (*said, s)


def _address(state, s):
    """state: -1 right after someone addressed, else words left for an insult;
    what stands before: nothing, a word that makes an insult literal, or any."""
    left, before = state
    kind, mark = _kind(s)
    if kind == "threat":
        return state, (s,)
    if kind in (INSULT, SLUR):
        if left:
            return (4, ""), ("address" + mark,)
        if kind == SLUR or not before:
            return (0, ""), ("loose" + mark,)
        return (0, ""), (OTHER if before == "literal" else "opening" + mark,)
    before = "literal" if kind in (DEFINITE, DEGREE, BEING) else ""
    if kind == TARGET:
        return (-1, before), (s,)
    if kind == DEFINITE or kind == OTHER and left < 0:
        return (0, before), (s,)
    if kind == BEING and left < 0:
        return (4, before), (s,)
    return (left if left < 0 else max(0, left - 1), before), (s,)


def _vocative(state, s):
    """state: words so far (3: more), and a loose insult that waits."""
    n, waits = state
    kind, mark = _kind(s)
    if s == END:
        return (n, None), (() if waits is None else ("vocative" + _kind(waits)[1],)) + (s,)
    if kind == "threat":  # stands beside the word it is aimed at
        return (n, waits), (s,)
    n, single = min(3, n + 1), kind in ("loose", "opening")
    if n == 3:
        return (3, None), (() if waits is None else (waits,)) + ((s,) if single or kind == "address" else ())
    if single and waits is None:
        return (n, s), ()
    if waits == "opening" and not single and kind != TARGET:  # the first part of a compound
        return (n, None), (waits,)
    return (n, waits), ((s,) if single or kind == "address" else ())


def _clause(state, s):
    """state: whether an insult has come, and the mark of the clause's loose
    ones (none, plain, or of the first).  An opening comes after the second
    word, which is then the run's."""
    armed, bare = state
    kind, mark = _kind(s)
    if s == END:
        return (False, None), (() if bare is None else ("bare" + bare,))
    if kind == "opening":
        return (True, bare), (("run" + bare,) if armed else ())
    if kind == "loose":
        return (True, mark if bare is None or not mark else bare), (("run" + mark,) if armed else ())
    return state, ((s,) if kind in PATTERNS else ())


def machines() -> list[Fst]:
    return [Fst(0, _Marker(NOT, "-", 3)), Fst(0, _Marker(REPORT, '"', 4)), Fst((1, "", 0, None), _threat), Fst((0, "nothing"), _address), Fst((0, None), _vocative), Fst((False, None), _clause)]


def grammar() -> Fst:
    """The composed transducer over ``SYMBOLS``; a clause ends with ``END``."""
    out, *rest = machines()
    for m in rest:
        out = out.then(m)
    return out


_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?;:\n"]] = True


def _opening(low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the first three bytes of words (stems have three at least)."""
    x = (low[starts].astype(np.uint32) << 16) | (low[starts + 1].astype(np.uint32) << 8) | low[starts + 2]
    return (x * np.uint32(2654435761)) >> np.uint32(16)


class Matcher:
    def __init__(self, lexicon: dict[str, str], fst: Fst, weights: dict[str, float]):
        self.fst, self.weights = fst, weights
        self.kinds = [OTHER, *SEED]
        self.stems = {w[:-1].encode(): self.kinds.index(k) for w, k in lexicon.items() if w.endswith("*")}
        self.lengths = sorted({len(x) for x in self.stems})
        self.opening = np.zeros(1 << 16, dtype=bool)
        for x in self.stems:
            self.opening[_opening(np.frombuffer(x, np.uint8), np.zeros(1, np.int64))] = True
        lexicon = {w: k for w, k in lexicon.items() if not w.endswith("*")}
        text = " ".join(lexicon).encode()
        buf = np.frombuffer(text, np.uint8)
        _, _, h, _ = words(buf, np.array([0, len(buf)]))
        order = np.argsort(h)
        self.hash, self.kind = h[order], np.array([self.kinds.index(k) for k in lexicon.values()])[order]
        self.bitmap = np.zeros(1 << 16, dtype=bool)
        self.bitmap[(self.hash >> np.uint64(48)).astype(np.int64)] = True

    def symbols(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=np.int64)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        out[at] = np.where(self.hash[k] == h[at], self.kind[k], 0)
        if self.stems:
            long = np.flatnonzero(ends - starts >= self.lengths[0])
            for i in long[self.opening[_opening(low, starts[long])]].tolist():
                word = low[starts[i] : ends[i]].tobytes()
                for size in self.lengths:
                    if not out[i] and word[:size] in self.stems:
                        out[i] = self.stems[word[:size]]
        return out

    def clauses(self, text: pa.Array) -> Iterator[tuple[int, list[str], int, int]]:
        """(row, marks, first byte, last byte) of every clause that has marks."""
        buf, offsets = bytes_of(text)
        core = [self.kinds.index(c) for c in CORE]
        for i, j in blocks(offsets):
            low = LOWER[buf[offsets[i] : offsets[j]]]
            starts, ends, h, at = words(low, offsets[i : j + 1] - offsets[i])
            symbol = self.symbols(low, starts, ends, h)
            hits = np.flatnonzero(np.isin(symbol, core))
            if not len(hits):
                continue
            stops = np.flatnonzero(_ENDS[low])
            clause = np.searchsorted(stops, starts)  # within the block
            doc = np.searchsorted(at, np.arange(len(h)), side="right") - 1
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(clause) != 0) | (np.diff(doc) != 0)]))
            for c in np.unique(np.searchsorted(edge, hits, side="right") - 1).tolist():
                lo, hi = edge[c], edge[c + 1] if c + 1 < len(edge) else len(h)
                marks = self.fst.run([*(self.kinds[s] for s in symbol[lo:hi].tolist()), END])
                if marks:
                    d = int(doc[lo])
                    base = offsets[i + d] - offsets[i]
                    yield i + d, marks, int(starts[lo] - base), int(ends[hi - 1] - base)

    def features(self, text: pa.Array) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
        """[texts, FEATURES] and the clauses that weigh: row, first and last
        byte, weight."""
        out = np.zeros((len(text), len(FEATURES)))
        clauses = []
        for d, marks, a, b in self.clauses(text):
            for m in marks:
                out[d, FEATURES.index(m)] += 1
            clauses.append((d, a, b, sum(self.weights[m] for m in marks), all(m in BARE for m in marks)))
        bare = [FEATURES.index(m) for m in BARE]
        several = out[:, bare].sum(axis=1) > 1
        out[:, [k for k in range(1, len(FEATURES)) if k not in bare]] += 1
        out = np.log2(np.maximum(1, out))
        out[:, 0] = 1
        return out, [c[:4] for c in clauses if several[c[0]] or not c[4]]

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.array([self.weights[f] for f in FEATURES])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def seed_lexicon() -> dict[str, str]:
    """Of a word of several classes the first counts."""
    return {word: kind for kind, text in reversed(SEED.items()) for word in text.split()}


#: Characters of a stem.
STEM = range(3, 9)


def _own_words(data: np.ndarray) -> Counter[str]:
    """How often a text has each word."""
    low = LOWER[data]
    starts, ends, h, _ = words(low, np.array([0, len(low)]))
    _, first, n = np.unique(h, return_index=True, return_counts=True)
    return Counter({low[s:e].tobytes().decode("utf-8", "replace"): k for s, e, k in zip(starts[first], ends[first], n.tolist(), strict=True)})


def _with_stems(own: Counter[str], sizes) -> Counter[str]:
    out = Counter(own)
    for w, n in own.items():
        for size in sizes:
            if len(w) >= size:
                out[w[:size] + "*"] += n
    return out


def _word_counts(sample: DataFrame, text_col: str, label: str) -> DataFrame:
    """(word, toxic, n, twice): texts with each word or stem, toxic ones, and
    those that have it twice; equal texts count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        toxic: Counter[str] = Counter()
        twice: Counter[str] = Counter()

        def flush():
            columns = [pa.array(list(n), pa.string()), *(pa.array([c[w] for w in n], pa.int64()) for c in (toxic, n, twice))]
            for c in (n, toxic, twice):
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "toxic", "n", "twice"])

        for batch in batches:
            buf, offsets = bytes_of(batch.column(0))
            labels = batch.column(1).to_pylist()
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                own = _with_stems(_own_words(buf[a:b]), STEM)
                n.update(own.keys())
                if labels[k]:
                    toxic.update(own.keys())
                twice.update(w for w, c in own.items() if c > 1)
                if len(n) > 150_000:
                    yield flush()
        yield flush()

    pairs = sample.select(text_col, label).dropDuplicates([text_col]).mapInArrow(run, "word string, toxic long, n long, twice long")
    return pairs.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "n", "twice")])


def _explain(sample: DataFrame, candidates: set[str], known: set[str], text_col: str, label: str, gain: int) -> list[str]:
    """Candidates that explain toxic texts, the most explaining first.  A text
    is explained by two places of known or taken words, as bare clauses need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = sorted({len(c) - 1 for c in candidates if c.endswith("*")})
        for batch in batches:
            out, left = [], []
            buf, offsets = bytes_of(batch.column(0))
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own = _own_words(buf[a:b])
                left.append(2 - sum(n for w, n in own.items() if w in known))
                has = [{"n": n, "by": sorted(set(_with_stems(Counter({w: n}), stems)) & candidates)} for w, n in sorted(own.items()) if w not in known]
                out.append([x for x in has if x["by"]])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(out, pa.list_(pa.struct([("n", pa.int32()), ("by", pa.list_(pa.string()))])))], names=["left", "has"])

    toxic = sample.where(F.col(label) == 1).select(text_col).distinct()
    got = toxic.mapInArrow(run, "left int, has array<struct<n:int,by:array<string>>>").where("left > 0 and size(has) > 0").collect()
    texts = [(r["left"], [(x["n"], set(x["by"])) for x in r["has"]]) for r in got]
    taken = []
    while texts:
        best, n = max(Counter(c for _, has in texts for c in set().union(*(by for _, by in has))).items(), key=lambda kv: (kv[1], len(kv[0]), kv[0]), default=("", 0))
        if n < gain:
            break
        taken.append(best)
        after = [(left - sum(k for k, by in has if best in by), [x for x in has if best not in x[1]]) for left, has in texts]
        texts = [(left, has) for left, has in after if left > 0 and has]
    return taken


def fitted(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> dict[str, float]:
    """Weights of ``FEATURES`` by Newton steps, held near their defaults."""
    prior = np.array([WEIGHTS[f] for f in FEATURES])
    w, size = prior.copy(), max(1.0, n.sum() / 1000)
    ridge = np.diag([1e-3, *[0.1] * (len(FEATURES) - 1)]) * size
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge
        w = w - np.clip(np.linalg.solve(h, x.T @ (n * (p - y)) + ridge @ (w - prior)), -1, 1)
    return dict(zip(FEATURES, w.tolist(), strict=True))


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", train=None, per_label: int = 2500, support: int = 5, purity: float = 0.95, gain: int = 2, most_words: int = 5000) -> Matcher:
    """Fit to ``docs`` (doc_id, text) labelled in ``labels`` (doc_id, label)
    where ``train``, a condition on doc_id, holds."""
    sample, counts = sample_labelled(docs, labels, label, per_label, train)
    text_col = "text"
    lexicon, fst = seed_lexicon(), grammar()
    if len(counts) < 2:
        return Matcher(lexicon, fst, WEIGHTS)
    sample = checkpoint(sample.select(text_col, label))
    enough = (F.col("n") >= support) | (F.col("n") >= 3) & (F.col("twice") >= 2)
    found = _word_counts(sample, text_col, label).where(enough & (F.col("toxic") >= purity * F.col("n"))).orderBy(F.desc("toxic"), "word").limit(most_words)
    for w in _explain(sample, {r["word"] for r in found.collect()}, {w for w, k in lexicon.items() if k == INSULT}, text_col, label, gain):
        lexicon.setdefault(w, SLUR)
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(lexicon, fst, WEIGHTS))

    def make():
        def apply(text):
            return [pa.array([x.tobytes() for x in shared.value.features(text)[0]], pa.binary())]

        return apply

    got = add_columns(sample, [text_col], [T.StructField("x", T.BinaryType())], make, keep=[label]).groupBy(label, "x").count().toPandas().sort_values([label, "x"])
    y, n = got[label].to_numpy(float), got["count"].to_numpy(float)
    for value in (0, 1):  # back to the labels' true shares
        if n[y == value].sum():
            n[y == value] *= counts[value] / n[y == value].sum()
    x = np.stack([np.frombuffer(v) for v in got["x"]]) if len(got) else np.zeros((0, len(FEATURES)))
    return Matcher(lexicon, fst, fitted(x, y, n))


def score(docs: DataFrame, matcher: Matcher, *, text_col: str = "text", threshold: float = 0.3, keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from ``threshold``) and, if
    asked for, the scoring clauses (start, end in UTF-8 bytes, weight)."""
    shared = docs.sparkSession.sparkContext.broadcast(matcher)
    clause = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("weight", T.DoubleType())]))

    def make():
        own = shared.value

        def apply(text):
            x, clauses = own.features(text)
            found: list[list] = [[] for _ in range(len(text))] if spans else []
            for d, a, b, w in clauses if spans else ():
                found[d].append({"start": a, "end": b, "weight": w})
            p = own.scores(x)
            out = [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            return [*out, pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())])))] if spans else out

        return apply

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())] + [T.StructField("clauses", clause)] * spans
    return add_columns(docs, [text_col], fields, make, keep=keep)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = held_out("doc_id", 4, 2)
    matcher = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=~held)
    return score(docs.withColumn("held_out", held), matcher, keep=["doc_id", "held_out"])
