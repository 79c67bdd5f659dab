"""Quality classifier: expectation-maximisation over overlapping labellers, whose posterior labels train a hashed linear scorer."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evplace.llm._shared import aside, dropped, mix64, small_batches, written

#: Hashed features of the scorer, of which at most so many have weights, and texts of label 1 and 0 that it is fitted on for each axis, at most.
FEATURES, CHOSEN, SAMPLE = 1 << 18, 1 << 14, (4000, 8000)
#: A feature's value is its share of a text's words times SCALE, at most 1: a few words of a long text count little, many of one no more than
#: enough. Values of texts of under SHORT words are less in proportion, as such texts tell little.
SCALE, SHORT = 60.0, 20
AXES = ("low", "toxic")
ABSTAIN = -1

#: Insults that the lexicon labellers know, by language.
INSULTS = {
    "en": "arsehole asshole bastard bitch clown creep cretin disgusting dumb dumbass fool freak idiot idiotic imbecile jerk loser moron pathetic scum scumbag stupid trash ugly vermin wanker worthless",
    "de": "abschaum arschloch bastard blödmann depp dreckskerl dummkopf erbärmlich hurensohn idiot idiotisch missgeburt penner schlampe schwachkopf trottel versager wertlos widerlich wichser",
    "fr": "abruti connard connasse crétin crétine débile enculé idiot idiote imbécile minable nullard ordure racaille raclure salaud salope stupide",
    "es": "asqueroso basura cabrón cretino escoria estúpido estúpida gilipollas idiota imbécil inútil mierda miserable patético payaso pendejo perdedor tonto",
}
#: Words that address a reader, by language.
ADDRESS = {"en": "you your yourself u ur", "de": "du dich dir dein deine ihr euch", "fr": "tu toi te ton ta vous votre", "es": "tú ti te tu usted ustedes vosotros"}
#: Function words that tell a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in is it that was for on as with be by from or are this which",
    "de": "der die das und ist nicht ein eine zu mit von auf für sich dem den im des",
    "fr": "le la les des du et est un une dans pour que qui pas sur par de en",
    "es": "el la los las del y que en un una por con para no es de se su",
}
#: Signs that stand for letters in masked spellings.
MASKS = str.maketrans("013457@$!", "oieastasi")
SIGNS = re.compile(r"[#$%&*@|!<>{}\[\]\\^~=+]")
#: Punctuation that may stand twice at the end of a word.
ENDS = "_.,;:?)\"'’»…-"
#: What is stripped from a token to get its word.
AROUND = ENDS + "(«¿¡!#$%&*@|<>{}[]\\^~=+"
WORD = re.compile(r"[^\W\d_]+")
LANGUAGES = ("en", "de", "fr", "es")
_lexicon: dict[str, int] = {}
for _bit, _words in enumerate([" ".join(INSULTS.values()), " ".join(ADDRESS.values()), *(FUNCTION_WORDS[x] for x in LANGUAGES)]):
    for _word in _words.split():
        _lexicon[_word] = _lexicon.get(_word, 0) | 1 << _bit
_masked = re.compile("|".join(sorted({"".join(re.escape(c) if k in (0, len(w) - 1) else f"[{c}*#]" for k, c in enumerate(w)) for x in INSULTS.values() for w in x.split() if len(w) >= 5})))


def _tailed(word: str) -> bool:
    """Do at least two symbols of any script end the word?"""
    return len(word) > 2 and all(not c.isalnum() and c not in ENDS for c in word[-2:])


def masked_insult(token: str) -> bool:
    """Does a token spell an insult with signs for some of its letters?"""
    plain = token.lower().strip(".,;:?!\"'()")
    if plain.isalpha() or not any(c.isalpha() for c in plain):
        return False
    return _masked.fullmatch(plain) is not None or bool(_lexicon.get(plain.translate(MASKS), 0) & 1)


def shape(token: str) -> str:
    """Letters as a or A, digits as 0, other characters as they are, runs of one shape as one; the last six."""
    if len(token) < 2 and not token.isalnum():
        return token
    out = []
    for c in token[:40]:
        s = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out[-6:])


#: Letters of a word that its hash takes.
WIDE = 24


def word_features(words: list[str]) -> np.ndarray:
    """Hashed features of words, [word, 3]: the whole word, its first four and its first six letters; -1 where it has fewer."""
    out = np.full((len(words), 3), -1, dtype=np.int64)
    if not words:
        return out
    c = np.array(words, dtype=f"<U{WIDE}").view(np.uint32).reshape(len(words), WIDE).astype(np.uint64)
    h = np.full(len(words), 1469598103934665603, dtype=np.uint64)
    for k in range(WIDE):
        h = np.where(c[:, k] > 0, (h ^ c[:, k]) * np.uint64(0x100000001B3), h)
        for column, letters in ((1, 4), (2, 6)):
            if k + 1 == letters:
                long = c[:, k] > 0
                out[long, column] = (mix64(h[long] + np.uint64(letters)) % np.uint64(FEATURES)).astype(np.int64)
    some = c[:, 0] > 0
    out[some, 0] = (mix64(h[some]) % np.uint64(FEATURES)).astype(np.int64)
    return out


def vote_features(axis: int, votes) -> list[int]:
    return [zlib.crc32(f"vote:{axis}:{k}:{v}".encode()) % FEATURES for k, v in enumerate(votes) if v != ABSTAIN]


class Tokens:
    """What is known of each distinct token, for up to ``room`` of them, so that texts are judged by arrays of token numbers."""

    #: Columns of what is known.
    SIZE, SIGN, LOUD, LONE, TAILED, MASKED, LEXICON = range(7)

    def __init__(self, room: int = 300_000):
        self.room = room
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.known, self.features = np.zeros((0, 7), np.float32), np.zeros((0, 4), np.int32)
        self.size = 0

    def _learn(self, new: list[str]) -> None:
        n = len(new)
        known, features = np.zeros((n, 7), np.float32), np.full((n, 4), -1, np.int32)
        words = [w.strip(AROUND).lower() for w in new]
        known[:, self.SIZE] = [len(w) for w in new]
        known[:, self.LEXICON] = [_lexicon.get(w, 0) for w in words]
        known[:, self.LOUD] = [len(w) > 1 and w.isupper() for w in new]
        # most tokens are a word with a usual mark or none behind it, which the shape of a short token tells
        bare = [w.rstrip(".,;:?") for w in new]
        kinds = ["a" if b.islower() else "A" if len(b) == 1 or b.isupper() else "Aa" if b.istitle() else "" for b in bare]
        usual = [b.isalpha() and k != "" for b, k in zip(bare, kinds)]
        names = [k + shape(w[len(b) :]) if u else shape(w) for w, b, k, u in zip(new, bare, kinds, usual)]
        different = dict.fromkeys(names)
        for name in different:
            different[name] = zlib.crc32(b"shape:" + name.encode()) % FEATURES
        shapes = np.array([different[x] for x in names])
        for i in np.flatnonzero(~np.array(usual)).tolist():
            w, core = new[i], words[i]
            known[i, self.SIGN] = len(SIGNS.findall(w))
            known[i, self.LONE], known[i, self.TAILED] = len(w) == 1 and not w.isalnum(), not w[-1].isalnum() and _tailed(w)
            if not core.isalpha():
                known[i, self.MASKED] = masked_insult(w)
                for x in WORD.findall(core):
                    known[i, self.LEXICON] = int(known[i, self.LEXICON]) | _lexicon.get(x, 0)
        features[:, 0] = shapes
        features[:, 1:] = word_features(words)
        if self.size + n > len(self.known):
            more = max(self.size + n, 2 * len(self.known)) - self.size
            self.known = np.concatenate([self.known[: self.size], np.zeros((more, 7), np.float32)])
            self.features = np.concatenate([self.features[: self.size], np.zeros((more, 4), np.int32)])
        self.known[self.size : self.size + n], self.features[self.size : self.size + n] = known, features
        self.ids.update(zip(new, range(self.size, self.size + n)))
        self.size += n

    def __call__(self, texts: list[str | None]):
        """Token numbers of all texts end to end, and the text of each."""
        if self.size > self.room:
            self.clear()
        words = [t.split() if t else [] for t in texts]
        flat = [w for x in words for w in x]
        new = list(dict.fromkeys(w for w in flat if w not in self.ids))
        if new:
            self._learn(new)
        return np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat)), np.repeat(np.arange(len(texts)), [len(x) for x in words])


def _vote(x: np.ndarray, good: float, bad: float, speaks: np.ndarray) -> np.ndarray:
    """1 from ``bad`` on, 0 up to ``good``, and nothing between, or where there is too little to judge by."""
    return np.where(~speaks, ABSTAIN, np.where(x >= bad, 1, np.where(x <= good, 0, ABSTAIN)))


def votes(tokens: Tokens, texts: list[str | None], ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each labeller of low quality and of toxicity says of each text, [text, labeller]: 1 yes, 0 no, -1 nothing.

    Low quality: symbols, shouting, lone separators, words with symbols at their ends, repeated words, repeated lines,
    words said again at once. Toxicity: share of insults, several different ones, an insult next to a word that addresses the
    reader, masked insults, and a calm text, which has none of these and addresses nobody.
    """
    k, T, room = len(texts), Tokens, tokens.size + 1
    known = tokens.known[ids]
    lexicon = known[:, T.LEXICON].astype(np.int64)
    of = lambda values: np.bincount(doc, weights=values, minlength=k)
    n = np.bincount(doc, minlength=k)
    n1 = np.maximum(n, 1)
    beside = lambda step: doc[step:] == doc[: max(len(doc) - step, 0)]
    again = np.bincount(doc[1:], weights=(ids[1:] == ids[:-1]) & beside(1), minlength=k)
    different = lambda some: np.bincount(np.unique(doc[some] * room + ids[some]) // room, minlength=k)
    lines = [[x for x in t.split("\n") if x] if t and t.count("\n") >= 4 else () for t in texts]
    n_lines = np.array([len(x) for x in lines])
    same = np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines])
    low = np.stack([
        _vote(of(known[:, T.SIGN]) / np.maximum(of(known[:, T.SIZE]), 1), 0.01, 0.06, n >= 3),
        _vote(of(known[:, T.LOUD]) / n1, 0.1, 0.3, n >= 5),
        _vote(of(known[:, T.LONE]) / n1, 0.01, 0.12, n >= 3),
        _vote(of(known[:, T.TAILED]) / n1, 0.02, 0.15, n >= 3),
        _vote(1 - different(slice(None)) / n1, 0.6, 0.8, n >= 50),
        _vote(same, 0.2, 0.5, (n_lines >= 5) & (n >= 3)),
        _vote(again / n1, 0.05, 0.3, n >= 8)], axis=1)
    insult, address = (lexicon & 1) > 0, (lexicon & 2) > 0
    hits, masked = of(insult), of(known[:, T.MASKED])
    # a word that addresses the reader among the three tokens before or after an insult, in its text
    near = np.zeros(len(ids), dtype=bool)
    for step in (1, 2, 3):
        m = max(len(ids) - step, 0)
        near[:m] |= insult[:m] & address[step:] & beside(step)
        near[step:] |= insult[step:] & address[:m] & beside(step)
    some = lambda x: np.where(x, 1, ABSTAIN)
    toxic = np.stack([
        _vote(hits / n1, 0.0, 0.01, n >= 3), some(different(insult) >= 2), some(of(near) > 0), some(masked > 0),
        np.where((n >= 20) & (hits + masked + of(address) == 0), 0, ABSTAIN)], axis=1)
    return low.astype(np.int32), toxic.astype(np.int32)


LABELLERS = (7, 5)


def values(features: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, feature, value of texts whose tokens have these features, [token, 4], -1 for none; doc is the text of each token."""
    n = np.maximum(np.bincount(doc, minlength=texts), 1)
    some = features.ravel() >= 0
    at, count = np.unique(np.repeat(doc, features.shape[1])[some] * FEATURES + features.ravel()[some], return_counts=True)
    return at // FEATURES, at % FEATURES, np.minimum(1.0, SCALE * count / n[at // FEATURES]) * np.minimum(1.0, n[at // FEATURES] / SHORT)


def languages(tokens: Tokens, texts: list[str | None], ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The language of each text, as a place in LANGUAGES, by its function words; len(LANGUAGES) for under two in a hundred words."""
    lexicon = tokens.known[ids, Tokens.LEXICON].astype(np.int64)
    found = np.stack([np.bincount(doc, weights=(lexicon >> (2 + i)) & 1, minlength=len(texts)) for i in range(len(LANGUAGES))], axis=1)
    n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
    return np.where(found.max(axis=1) * 50 >= n, found.argmax(axis=1), len(LANGUAGES)).astype(np.int32)


#: How far the label table is trusted: the share of its labels that are right.
TRUST = 0.999


def fit_labellers(votes: np.ndarray, counts: np.ndarray, told: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of label 1 for each pattern of votes, and each labeller's estimated accuracy where it speaks.

    Labellers are taken as independent given the label; what they say, or that they abstain, has its own
    probability for each label, which is estimated. ``told`` is what the label table says (-1: nothing): it anchors the labels at the
    fixed trust TRUST, and whether it speaks tells nothing. At the start a text is likely 1 if any labeller says so, as each knows one kind only.
    """
    said = votes != ABSTAIN
    total = counts.sum()
    anchor = np.zeros(len(votes))
    if told is not None:
        anchor = np.where(told == 1, 1.0, np.where(told == 0, -1.0, 0.0)) * np.log(TRUST / (1 - TRUST))
    post = np.where((votes == 1).any(axis=1), 0.8, np.where(said.any(axis=1), 0.02, 0.1))
    post = np.where(anchor > 0, 0.99, np.where(anchor < 0, 0.01, post))
    states = np.stack([votes == s for s in (ABSTAIN, 0, 1)], axis=2).astype(np.float64)  # pattern, labeller, state
    for _ in range(rounds):
        w = np.stack([counts * (1 - post), counts * post])
        prior = w.sum(axis=1) / total
        # a tenth of a pseudo-count for each state, more for the right one, as labellers are better than chance
        hint = np.array([[[0.1, 0.3, 0.05]], [[0.1, 0.05, 0.3]]])
        theta = np.einsum("yp,pls->yls", w, states) + hint
        theta /= theta.sum(axis=2, keepdims=True)
        loglik = np.log(np.maximum(prior, 1e-9)) + np.einsum("pls,yls->py", states, np.log(theta))
        post = 1 / (1 + np.exp(np.clip(loglik[:, 0] - loglik[:, 1] - anchor, -50, 50)))
    right = (counts[:, None] * ((votes == 1) * post[:, None] + (votes == 0) * (1 - post[:, None]))).sum(axis=0)
    return post, right / np.maximum((counts[:, None] * said).sum(axis=0), 1)


def fit_linear(ends: np.ndarray, idx: np.ndarray, x: np.ndarray, label: np.ndarray, prior: float, steps: int = 300) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic scorer of texts whose features and values lie end to end.

    Texts of a label weigh together as much as the label's share of all texts. The intercept is that share's, so that a text without
    any feature gets the prior.
    """
    w = np.zeros(FEATURES + 1)
    pos, neg = float(label.sum()), float((1 - label).sum())
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if not pos or not neg:
        return w
    used, at = np.unique(idx, return_inverse=True)
    doc = np.repeat(np.arange(len(label)), np.diff(ends))
    weight = np.where(label == 1, prior / pos, (1 - prior) / neg)
    v, squares = np.zeros(len(used)), np.full(len(used), 1e-8)
    for _ in range(steps):
        s = np.bincount(doc, weights=v[at] * x, minlength=len(label)) + w[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - label)
        grad = np.bincount(at, weights=g[doc] * x, minlength=len(used)) + 1e-6 * v
        squares += grad * grad
        v -= 0.5 * grad / np.sqrt(squares)
    w[used] = v
    return w


def _parts(batch, size: int = 1_000_000):
    """Rows of a batch in slices of about so many bytes of text."""
    column, at, held = batch.column(1), 0, 0
    for i in range(batch.num_rows):
        held += len(column[i].as_buffer() or b"") if column[i].is_valid else 0
        if held > size or i - at >= 512:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel(), pa.int32()))


def _scan(batches):
    tokens = Tokens()
    for batch in batches:
        for part in _parts(batch):
            texts = part.column(1).to_pylist()
            ids, doc = tokens(texts)
            low, toxic = votes(tokens, texts, ids, doc)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(languages(tokens, texts, ids, doc), pa.int32()), _lists(low), _lists(toxic)], ["id", "lang", "low", "toxic"])


def _votes(d: DataFrame, labels: DataFrame | None) -> DataFrame:
    """id, low, toxic: a text's language, then its votes, the last one that of the label table, where it has one."""
    said = d.mapInArrow(_scan, "id long, lang int, low array<int>, toxic array<int>")
    silent = F.lit(ABSTAIN)
    if labels is None:
        said = said.withColumns({"l": silent, "t": silent})
    else:
        told = labels.groupBy(F.col("doc_id").try_cast("long").alias("id")).agg((1 - F.min("quality")).alias("l"), F.max("toxic").alias("t"))
        said = said.join(told, "id", "left")
    vote = lambda c: F.array(F.coalesce(F.when(F.col(c).isin(0, 1), F.col(c)), silent).cast("int"))
    return said.select("id", *[F.concat(F.array("lang"), axis, vote(c)).alias(axis) for axis, c in (("low", "l"), ("toxic", "t"))])


def _bounded(rows: DataFrame, sample: tuple[int, int]) -> DataFrame:
    """At most so many rows of label 1 and 0 for each axis, by a hash, as one id may be on very many rows."""
    crowded = rows.groupBy("axis", "label").count().collect()
    if all(r["count"] <= (sample[0] if r["label"] else sample[1]) for r in crowded):
        return rows
    out = None
    for axis in range(len(AXES)):
        for label, most in ((1, sample[0]), (0, sample[1])):
            some = rows.where((F.col("axis") == axis) & (F.col("label") == label)).orderBy(F.xxhash64("features", "x"), "features", "x").limit(most)
            out = some if out is None else out.unionByName(some)
    return written(out, "sample-bounded")


def _features(batches):
    """axis, label, features, x (values) of texts (id, text, axis, label): those of words by their share, those of votes as ones."""
    tokens = Tokens()
    for batch in batches:
        for part in _parts(batch):
            texts, axis = part.column(1).to_pylist(), part.column(2).to_pylist()
            ids, doc = tokens(texts)
            said = votes(tokens, texts, ids, doc)
            of, f, x = values(tokens.features[ids].astype(np.int64), doc, len(texts))
            own = [(i, v) for i, a in enumerate(axis) for v in vote_features(a, said[a][i])]
            of, f, x = np.append(of, [i for i, _ in own]).astype(np.int64), np.append(f, [v for _, v in own]).astype(np.int32), np.append(x, np.ones(len(own)))
            order = np.argsort(of, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(v[order])) for v in (f, x.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), *lists], ["axis", "label", "features", "x"])


def _sums(batches):
    """axis, feature, then for label 0 and 1: texts that have it, sum and sum of squares of its values; added up in a task."""
    total = np.zeros((len(AXES), 6, FEATURES))
    for batch in batches:
        axis, label = (np.asarray(batch.column(k)) for k in (0, 1))
        n = np.asarray(batch.column(2).value_lengths())
        f, x = np.asarray(batch.column(2).flatten()), np.asarray(batch.column(3).flatten()).astype(np.float64)
        a, y = np.repeat(axis, n), np.repeat(label, n)
        for i in range(len(AXES)):
            for j in (0, 1):
                here = (a == i) & (y == j)
                for k, v in enumerate((np.ones(int(here.sum())), x[here], x[here] ** 2)):
                    total[i, 3 * j + k] += np.bincount(f[here], weights=v, minlength=FEATURES)
    for i in range(len(AXES)):
        at = np.flatnonzero(total[i, 0] + total[i, 3])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int32()), pa.array(at, pa.int32()), *[pa.array(total[i, k, at]) for k in range(6)]], ["axis", "feature", *(f"v{k}" for k in range(6))])


def _telling(sample: DataFrame) -> dict[int, np.ndarray]:
    """For each axis the features, at most CHOSEN, that tell its labels apart: in at least three texts, and their mean values over four standard errors
    apart, by the spread of both labels together."""
    sizes = {(r["axis"], r["label"]): r["n"] for r in sample.groupBy("axis", "label").agg(F.count("*").alias("n")).collect()}
    values = ["v0", "v1", "v2", "v3", "v4", "v5"]
    sums = sample.mapInArrow(_sums, "axis int, feature int, " + ", ".join(f"{v} double" for v in values)).groupBy("axis", "feature").agg(*[F.sum(v).alias(v) for v in values])
    out = {}
    for axis in range(len(AXES)):
        n0, n1 = (float(sizes.get((axis, y), 0)) for y in (0, 1))
        if not n0 or not n1:
            continue
        mean = (F.col("v1") + F.col("v4")) / (n0 + n1)
        spread = F.greatest(((F.col("v2") + F.col("v5")) / (n0 + n1) - mean * mean) * (1 / n0 + 1 / n1), F.lit(1e-12))
        z = F.abs(F.col("v4") / n1 - F.col("v1") / n0) / F.sqrt(spread)
        best = sums.where(F.col("axis") == axis).where(F.col("v0") + F.col("v3") >= 3).withColumn("z", z).where("z > 4").orderBy(F.desc("z"), "feature").limit(CHOSEN)
        out[axis] = np.array(sorted(r["feature"] for r in best.select("feature").collect()), dtype=np.int64)
    return out


def fit(d: DataFrame, labels: DataFrame | None, sample: tuple[int, int] = SAMPLE) -> tuple[np.ndarray, dict]:
    """Weights [axis, feature] and what was learned about the labellers, from texts d (id, text).

    Patterns of votes are counted over all texts: 3**8 and 3**6 patterns for each language at most reach the driver, where the
    EM runs; for toxicity on those of one language at a time, as a lexicon's silence tells nothing in a language it does not know. The scorer is fitted on a bounded sample: for each axis at most sample[0] texts of posterior 0.9 or more
    and sample[1] of 0.1 or less for which some labeller spoke (under 0.7 of what all texts of their language have), by a hash of their ids. Features are chosen by
    sums over the sample; the texts' values of these alone go to the task that fits an axis.
    """
    spark = d.sparkSession
    said = written(_votes(d, labels), "votes")
    learned, chosen, priors = {}, None, []
    for axis in AXES:
        rows = said.groupBy(axis).count().collect()
        if not rows:
            return np.zeros((len(AXES), FEATURES + 1)), {}
        pattern, counts = np.array([r[axis] for r in rows]), np.array([r["count"] for r in rows], dtype=np.float64)
        post, base, accuracy = np.zeros(len(rows)), np.zeros(len(rows)), {}
        group = pattern[:, 0] if axis == "toxic" else np.zeros(len(rows), np.int64)
        for lang in np.unique(group).tolist():
            own = group == lang
            post[own], right = fit_labellers(pattern[own, 1:-1], counts[own], pattern[own, -1])
            base[own] = (counts[own] * post[own]).sum() / counts[own].sum()
            accuracy[lang] = right.tolist()
        learned[axis] = {"prior": float((counts * post).sum() / counts.sum()), "accuracy": accuracy}
        priors.append(learned[axis]["prior"])
        spoken = (pattern[:, 1:] != ABSTAIN).any(axis=1)
        keys = [",".join(map(str, p)) for p in pattern.tolist()]
        for label, most, picked in ((1, sample[0], spoken & (post >= 0.9)), (0, sample[1], spoken & (post <= np.minimum(0.1, 0.7 * base)))):
            some = said.where("id is not null").where(F.array_join(axis, ",").isin([k for k, p in zip(keys, picked) if p]))
            some = some.orderBy(F.xxhash64("id"), "id").limit(most).select("id", F.lit(AXES.index(axis)).alias("axis"), F.lit(label).alias("label"))
            chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * sum(sample) rows, so they may be broadcast; an id that is repeated is there as often as in d, within the bound
    picked = written(chosen.distinct(), "chosen")
    rows = written(d.join(F.broadcast(picked), "id").select("id", "text", "axis", "label").mapInArrow(_features, "axis int, label int, features array<int>, x array<float>"), "sample")
    dropped(said)
    rows = _bounded(rows, sample)
    telling = spark.sparkContext.broadcast(_telling(rows))

    def slim(batches):
        for batch in batches:
            axis = np.asarray(batch.column(0))
            n = np.asarray(batch.column(2).value_lengths())
            f, x = np.asarray(batch.column(2).flatten()), np.asarray(batch.column(3).flatten())
            a, doc = np.repeat(axis, n), np.repeat(np.arange(len(n)), n)
            keep = np.zeros(len(f), dtype=bool)
            for i, these in telling.value.items():
                keep |= (a == i) & np.isin(f, these)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(n)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(f[keep])), pa.ListArray.from_arrays(ends, pa.array(x[keep]))], ["axis", "label", "features", "x"])

    def train(key, pdf):
        ends = np.concatenate([[0], np.cumsum([len(f) for f in pdf["features"]])]).astype(np.int64)
        w = fit_linear(ends, np.concatenate(list(pdf["features"])).astype(np.int64), np.concatenate(list(pdf["x"])).astype(np.float64), pdf["label"].to_numpy(dtype=np.float64), priors[key[0]])
        return pd.DataFrame({"axis": [key[0]], "w": [w.astype(np.float32).tobytes()]})

    got = rows.mapInArrow(slim, "axis int, label int, features array<int>, x array<float>").groupBy("axis").applyInPandas(train, "axis int, w binary").collect()
    dropped(rows)
    dropped(picked)
    weights = np.zeros((len(AXES), FEATURES + 1), np.float32)
    weights[:, -1] = [np.log(max(p, 1e-6) / max(1 - p, 1e-6)) for p in priors]
    for r in got:
        weights[r["axis"]] = np.frombuffer(r["w"], np.float32)
    return weights, learned


def scores(d: DataFrame, weights: np.ndarray) -> DataFrame:
    """d (x, text) as x, p_low, p_toxic."""
    shared = d.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w, tokens = shared.value, Tokens()
        used = (w[:, :-1] != 0).any(axis=0)
        of_vote = [{(k, v): float(w[axis, vote_features(axis, [ABSTAIN] * k + [v])].sum()) for k in range(LABELLERS[axis]) for v in (0, 1)} for axis in (0, 1)]
        for batch in batches:
            for part in _parts(batch):
                texts = part.column(1).to_pylist()
                ids, doc = tokens(texts)
                known = tokens.features[: tokens.size]
                known = np.where(used[known] & (known >= 0), known, -1).astype(np.int64)
                of, f, x = values(known[ids], doc, len(texts))
                p = []
                for axis, said in enumerate(votes(tokens, texts, ids, doc)):
                    logit = w[axis, -1] + np.bincount(of, weights=w[axis, f] * x, minlength=len(texts))
                    for (k, v), y in of_vote[axis].items():
                        logit += y * (said[:, k] == v)
                    p.append(1 / (1 + np.exp(-np.clip(logit, -40, 40))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p[0]), pa.array(p[1])], ["x", "p_low", "p_toxic"])

    # as types, not as text: x may be a struct with columns of any name
    return d.mapInArrow(run, T.StructType([T.StructField("x", d.schema["x"].dataType), *[T.StructField(c, T.DoubleType()) for c in ("p_low", "p_toxic")]]))


def classified(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", sample: tuple[int, int] = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row for each document row: doc_id, p_low, p_toxic, kept (both under ``threshold``).

    Seven heuristic labellers judge low quality and five toxicity, with lexicons of four languages; a table of labels (doc_id,
    quality, toxic) is one more labeller of each, silent where it has no row, and trusted where it speaks. EM estimates how far to
    trust the others; texts with a sure posterior train the scorer, a logistic model of hashed words, word beginnings, token shapes and the
    heuristics' votes, which then judges all whole texts, in whatever language labels or lexicons spoke of. Null and
    empty texts, and those of under three words, give the heuristics nothing to say. Repeated
    rows are judged alike, a null doc_id is judged like others. With no text, or no label of one kind, the
    scorer knows the prior alone. Where labels repeat a doc_id, the worst of each counts. An empty table gives no rows. Extra columns are ignored.
    doc_id must be a whole number; other types are cast to long, and ids that are none become null.
    """
    d = small_batches(docs).select(F.col(doc_id).try_cast("long").alias("id"), F.col(text).alias("text"))
    weights, _ = fit(d, labels, sample)
    out = scores(d.select(F.col("id").alias("x"), "text"), weights)
    return out.select(F.col("x").alias(doc_id), "p_low", "p_toxic", ((F.col("p_low") < threshold) & (F.col("p_toxic") < threshold)).alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", sample: tuple[int, int] = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that classified() keeps, with the columns of docs, whatever their names; other cases as there."""
    weights, _ = fit(small_batches(docs).select(F.col(doc_id).try_cast("long").alias("id"), F.col(text).alias("text")), labels, sample)
    whole = docs.select(aside(docs).alias("x"), F.col(text).alias("text"))
    return scores(whole, weights).where((F.col("p_low") < threshold) & (F.col("p_toxic") < threshold)).select("x.*")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return classified(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
