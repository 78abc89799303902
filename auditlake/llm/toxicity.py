"""Toxicity by a weighted finite-state pattern grammar over clauses.

Texts are read as words, clause ends and quotation marks. A lexicon turns words into
a few symbols: insults that are listed here, insult roots learned from labels,
violent verbs, words of intent, address, negation, contrast and report. The grammar is
a composition of small transducers:

* reported speech reads the symbols and hands on insults and violence within
  quotation marks, or behind a verb of report, as softened;
* negation does the same for those that stand within reach of a negating word;
* insults, threats (violence within reach of intent) and targets are counted side by
  side, and what a clause holds is put out at its end.

So a score rests on matched clauses: a clause of one softened insult is another
pattern than one that insults its reader twice. Learned weights of these patterns,
drawn towards those given here, and a logistic curve make the score.

Insult roots are beginnings of words found in labelled toxic texts and in next to no
clean one. They are chosen greedily, so that each explains texts that no listed
insult and no other root explains: words that toxic texts share because they are
copies of each other explain nothing more.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prefix_hash, slices, span_hash, text_buffers, written
from .quality import held_out

LISTED, LEARNED, VIOLENT, INTENT, TARGET, NEGATION, CONTRAST, REPORT, QUOTE, GAP, END, LINE = range(12)
SOFT = 12

# Words by symbol; a star stands for any ending.
WORDS = {
    LISTED: """idiot* moron* stupid* imbecile* dumbass* dumb jerk* loser* scum scumbag* pathetic worthless disgusting trash garbage clown* fool* retard* cretin*
        pig pigs filth vermin parasite* coward* bastard* bitch* asshole* arsehole* shithead* fucker* fuckface motherfucker* cunt* whore* slut* dickhead* prick pricks wanker*
        idiote* connard* connasse* salaud* salope* ordure* minable* débile* crétin* abruti* pourriture* enfoiré*
        dummkopf* arschloch* trottel* vollidiot* schwachkopf* abschaum* wichser* hurensohn* drecksau* miststück* schlampe*
        estúpid* imbécil* cabrón* cabrones pendejo* gilipollas escoria malnacid* basura puta putas idiotez* asqueros*""",
    VIOLENT: """kill* murder* shoot stab strangle* slaughter* hang beat burn hurt destroy* smash* punch* crush* exterminate* rape* behead*
        tuer tuerai crever égorger frapper massacrer töten umbringen erschießen erwürgen verprügeln matar mataré matarte golpear degollar""",
    INTENT: """will gonna going shall i'll we'll should must deserve* hope wish vais allons va devrait espère werde werden sollte hoffe voy vamos debería ojalá""",
    TARGET: """you your you're youre yourself u ur he she they them him her his their these those people tu toi vous ton ta votre vos ils elles du dich dir ihr euch sie dein deine
        tú te usted ustedes vosotros ellos ellas""",
    NEGATION: """not no never neither nor isn't aren't wasn't don't doesn't didn't won't wouldn't can't cannot without hardly ne pas jamais aucun sans nicht kein keine keinen nie niemals ohne
        nunca jamás ningún ninguna sin""",
    CONTRAST: "but only just except mais sauf sondern aber pero sino",
    REPORT: """said says saying called calls calling wrote writes claimed claims quoted quotes reported reports reportedly alleged allegedly told tells shouted according dit disait appelé écrit
        selon sagte sagt nannte schrieb laut dijo dice llamó escribió según""",
}

#: Plain words that may stand between two symbols that act on each other.
REACH = 5
#: Shortest and longest root, in code points.
ROOT = (3, 10)
#: The grammar and its lexicon are fitted on at most so many labelled rows, those with the smallest hash of their id.
TRAIN_ROWS = 20_000
#: Beginnings of words that are counted among clean texts too: those that most toxic texts of the sample have.
CANDIDATES = 100_000
#: Toxic texts (copies count as one) that a root has to explain first, or to hold if it explains none anew; clean ones weigh so much against it.
EXPLAINS, HOLDS, CLEAN = 3, 8, 4
THRESHOLD = 0.5
#: Bytes of a text that are read at once.
CHUNK = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?;")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


# --- transducers ---------------------------------------------------------------------------------


@dataclass
class Transducer:
    """Reads symbols; `step` gives the next state and what is put out (None: nothing). A symbol without a step is handed on."""

    start: Hashable
    step: Callable[[Hashable, int], tuple[Hashable, Hashable] | None]

    def __call__(self, state, symbol):
        return self.step(state, symbol) or (state, symbol)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """second reads what first puts out."""

    def step(state, symbol):
        a, out = first(state[0], symbol)
        if out is None:
            return (a, state[1]), None
        b, out = second(state[1], out)
        return (a, b), out

    return Transducer((first.start, second.start), step)


def beside(*machines: Transducer) -> Transducer:
    """All machines read the same symbols; at the end of a clause they put out together what each found, and begin anew."""

    def step(state, symbol):
        moved = [m(q, symbol) for m, q in zip(machines, state)]
        if symbol in (END, LINE):
            return tuple(m.start for m in machines), tuple(out for _, out in moved)
        return tuple(q for q, _ in moved), None

    return Transducer(tuple(m.start for m in machines), step)


def counter(symbol: int, most: int) -> Transducer:
    """How often the symbol stands in a clause, `most` at most."""
    return Transducer(0, lambda q, s: (q, q) if s in (END, LINE) else (min(q + 1, most), None) if s == symbol else None)


def _threats(q, s):
    if s in (END, LINE):
        return 0, int(q == 2)
    if q < 2:
        return {INTENT: (1, None), GAP: (0, None), VIOLENT: (2 if q else 0, None)}.get(s)
    return None


def _negated(q, s):
    if s == NEGATION:
        return 1, None
    if s in (GAP, END, LINE, CONTRAST):
        return 0, s
    return (1, SOFT) if q and s in (LISTED, LEARNED, VIOLENT) else None


def _reported(q, s):
    verb, quoted = q
    if s == REPORT:
        return (1, quoted), None
    if s == QUOTE:
        return (verb, 1 - quoted), None
    if s in (END, LINE):
        return (0, quoted if s == END else 0), s
    return (q, SOFT) if (verb or quoted) and s in (LISTED, LEARNED, VIOLENT) else None


def grammar() -> Transducer:
    found = beside(counter(LISTED, 2), counter(LEARNED, 2), counter(SOFT, 1), Transducer(0, _threats), counter(TARGET, 1))
    return compose(Transducer((0, 0), _reported), compose(Transducer(0, _negated), found))


def tables(machine: Transducer, symbols: int = SOFT) -> tuple[np.ndarray, np.ndarray, list]:
    """The machine's reachable states as arrays: the next state and the output by state and symbol (-1: none), and the outputs."""
    number, queue, steps, outs, made = {machine.start: 0}, [machine.start], [], [], {}
    for state in queue:
        row, put = [], []
        for s in range(symbols):
            there, out = machine(state, s)
            if there not in number:
                number[there] = len(queue)
                queue.append(there)
            row.append(number[there])
            put.append(made.setdefault(out, len(made)) if isinstance(out, tuple) else -1)
        steps.append(row)
        outs.append(put)
    return np.array(steps, np.int32), np.array(outs, np.int32), list(made)


def run_machine(steps: np.ndarray, outs: np.ndarray, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The output after each symbol, of sequences that lie one after another and all begin in state 0: all sequences move at once."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, ranked = starts[order], lengths[order]
    state, put = np.zeros(len(lengths), np.int32), np.full(len(symbols), -1, np.int32)
    for k in range(int(ranked[0]) if len(ranked) else 0):
        live = int(np.searchsorted(-ranked, -k, side="left"))
        at = starts[:live] + k
        s = symbols[at]
        put[at] = outs[state[:live], s]
        state[:live] = steps[state[:live], s]
    return put


# --- reading ---------------------------------------------------------------------------------------


@dataclass
class Lexicon:
    """64-bit hashes of words and of beginnings of words by symbol. Roots are found by their first ROOT[0] code points first."""

    words: np.ndarray
    word_symbols: np.ndarray
    roots: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def hash_of(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0]


def lexicon(learned: list[tuple[int, int, int]] = ()) -> Lexicon:
    """The listed words, and learned roots given by hash, length and hash of their first ROOT[0] code points."""
    words: dict[int, int] = {}
    roots: dict[int, dict[int, int]] = {}
    heads = {head for _, _, head in learned}
    for h, n, _ in learned:
        roots.setdefault(n, {})[h] = LEARNED
    for symbol, text in WORDS.items():
        for word in text.split():
            if word.endswith("*"):
                roots.setdefault(len(word) - 1, {})[int(hash_of(word[:-1]))] = symbol
                heads.add(int(hash_of(word[: ROOT[0]])))
            else:
                words[int(hash_of(word))] = symbol

    def arrays(found):
        keys = np.array(sorted(found), np.uint64)
        return keys, np.array([found[int(k)] for k in keys], np.int8)

    return Lexicon(*arrays(words), {n: arrays(x) for n, x in sorted(roots.items())}, np.array(sorted(heads), np.uint64))


def _among(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted keys; a bitmap over 16 bits spares most of the look-ups."""
    if not len(keys):
        return np.zeros(len(hashes), bool)
    seen = np.zeros(1 << 16, bool)
    seen[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
    some = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(keys, hashes[some]), len(keys) - 1)
    out[some] = keys[place] == hashes[some]
    return out


@dataclass
class Read:
    """Words of lower-cased texts: their places, and what is needed to hash them and their beginnings."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    prefix: np.ndarray
    points: np.ndarray
    first: np.ndarray
    letter: np.ndarray

    def beginning(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the words `which` that have n code points, and the hashes of their first n."""
        end = self.points[np.minimum(self.first[which] + n, len(self.points) - 1)]
        which, end = which[fits := end <= self.ends[which]], end[fits]
        return which, span_hash(self.prefix, self.starts[which], end)


def read(data: np.ndarray, offsets: np.ndarray) -> Read:
    """Words are runs of letters, digits, apostrophes and bytes from 128 up, but for the punctuation of U+0080 to U+00BF and U+2000 to U+203F."""
    low = _LOWER[data]
    letter = _LETTER[low]
    if len(low) > 1:
        latin = np.flatnonzero(low[:-1] == 0xC3) + 1
        latin = latin[(low[latin] >= 0x80) & (low[latin] <= 0x9E) & (low[latin] != 0x97)]
        low[latin] += 32
        sign = np.flatnonzero(low[:-1] == 0xC2)
        letter[sign] = letter[sign + 1] = False
        wide = np.flatnonzero((low[:-1] == 0xE2) & (low[1:] == 0x80))
        for k in range(3):
            letter[wide[wide + k < len(low)] + k] = False
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] |= letter[inner]
    end[inner - 1] |= letter[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    point = (low & 0xC0) != 0x80
    points = np.append(np.flatnonzero(point), len(low))
    of = np.searchsorted(offsets, starts, side="right") - 1
    return Read(low, starts, ends, of, prefix_hash(low), points, np.searchsorted(points, starts), letter)


def word_symbols(r: Read, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The words that the lexicon knows, in order, and their symbols. Words come before roots, longer roots before shorter ones, listed ones before learned ones."""
    out = np.full(len(r.starts), -1, np.int8)
    every = np.arange(len(r.starts))
    head, hashes = r.beginning(every, ROOT[0])
    head = head[_among(hashes, lex.heads)] if len(lex.heads) else head[:0]
    for n, (keys, symbols) in lex.roots.items():
        some, hashes = r.beginning(head, n)
        hit = _among(hashes, keys)
        out[some[hit]] = symbols[np.searchsorted(keys, hashes[hit])]
    hashes = span_hash(r.prefix, r.starts, r.ends)
    hit = _among(hashes, lex.words)
    out[hit] = lex.word_symbols[np.searchsorted(lex.words, hashes[hit])]
    known = np.flatnonzero(out >= 0)
    return known, out[known]


def events(r: Read, lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in order of place: words of the lexicon, clause ends, line ends, quotation marks. Their byte, the words before them, the symbol."""
    known, symbols = word_symbols(r, lex)
    data = r.data
    quote = data == 34
    if len(data) > 2:
        quote[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB))
        quote[:-2] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x9C) & (data[2:] <= 0x9E)
    marks = np.flatnonzero(quote | _END[data] | (data == 10))
    kind = np.where(quote[marks], QUOTE, np.where(data[marks] == 10, LINE, END)).astype(np.int8)
    at = np.concatenate([r.starts[known], marks])
    order = np.argsort(at, kind="stable")
    before = np.concatenate([known, np.searchsorted(r.starts, marks)])
    return at[order], before[order], np.concatenate([symbols, kind])[order]


def _streams(at, before, symbols, of, n_texts):
    """The symbols of texts that hold an insult or violence, cut at line ends, with a gap where words lie too far apart and a line end behind each text."""
    hot = np.isin(symbols, (LISTED, LEARNED, VIOLENT))
    keep = np.bincount(of[hot], minlength=n_texts)[of] > 0
    before, symbols, of = before[keep], symbols[keep], of[keep]
    if not len(symbols):
        return symbols, of, np.zeros(0, np.int64)
    same = of[1:] == of[:-1]
    word = symbols < QUOTE
    far = np.flatnonzero(same & word[1:] & (np.diff(before) > REACH)) + 1
    last = np.append(np.flatnonzero(~same) + 1, len(of))
    places = np.concatenate([far, last])
    added = np.concatenate([np.full(len(far), GAP), np.full(len(last), LINE)]).astype(np.int8)
    whose = np.concatenate([of[far], of[last - 1]])
    order = np.argsort(places, kind="stable")
    symbols, of = np.insert(symbols, places[order], added[order]), np.insert(of, places[order], whose[order])
    ends = np.flatnonzero(symbols == LINE)
    return symbols, of, np.diff(np.concatenate([[-1], ends]))


# --- features ----------------------------------------------------------------------------------------

FEATURES = ("listed", "listed twice", "learned", "learned twice", "softened only", "threat", "at a target", "two matches", "matches a thousand words", "threat at a target")
#: Weights before any label is seen, and how many labelled rows they count for.
PRIOR = np.array([-3.0, 2.0, 1.0, 2.0, 1.0, 0.1, 1.5, 0.7, 1.5, 0.2, 2.0])
PRIOR_STRENGTH = 0.05


def clause_features(patterns: list[tuple]) -> np.ndarray:
    """What a clause of each pattern counts for."""
    out = np.zeros((len(patterns), 8))
    for k, (listed, learned, soft, threat, target) in enumerate(patterns):
        strong = listed or learned or threat
        out[k] = [listed > 0, listed > 1, learned > 0, learned > 1, bool(soft and not strong), threat, bool(target and strong), listed + learned + threat]
    return np.column_stack([out, out[:, 5] * np.array([bool(p[4]) for p in patterns])]) if len(patterns) else np.zeros((0, 9))


class Grammar:
    """The composed machine as tables, with a lexicon: gives the features of texts."""

    def __init__(self, lex: Lexicon):
        self.lex = lex
        self.steps, self.outs, self.patterns = tables(grammar())
        self.counts = clause_features(self.patterns)

    def features(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_buffers(column)
        sizes, n = np.diff(offsets), len(column)
        parts, words, done = [], np.zeros(n, np.int64), 0
        short = sizes <= CHUNK
        if short.any() and data.size:
            pieces = [(offsets[a], offsets[b], a, b) for a, b in _runs(short)]
        else:
            pieces = []
        for first, last, a, b in pieces:
            r = read(data[first:last], offsets[a : b + 1] - first)
            at, before, symbols = events(r, self.lex)
            parts.append((at + first, before, symbols, np.searchsorted(offsets[a : b + 1] - first, at, side="right") - 1 + a))
            words[a:b] = np.bincount(r.of, minlength=b - a)
        for k in np.flatnonzero(~short):
            done = 0
            for first, last in chunks(data, int(offsets[k]), int(offsets[k + 1])):
                r = read(data[first:last], np.array([0, last - first]))
                at, before, symbols = events(r, self.lex)
                parts.append((at + first, before + done, symbols, np.full(len(at), k)))
                done += len(r.starts)
            words[k] = done
        out = np.zeros((n, len(FEATURES)))
        if not parts:
            return out
        at, before, symbols, of = (np.concatenate(x) for x in zip(*parts))
        if len(pieces) and not short.all():
            order = np.argsort(at, kind="stable")
            at, before, symbols, of = at[order], before[order], symbols[order], of[order]
        symbols, of, lengths = _streams(at, before, symbols, of, n)
        put = run_machine(self.steps, self.outs, symbols, lengths)
        hit = np.flatnonzero(put >= 0)
        total = np.zeros((n, 9))
        np.add.at(total, of[hit], self.counts[put[hit]])
        out[:, :7] = np.log1p(total[:, :7])
        out[:, 7] = total[:, 7] >= 2
        out[:, 8] = np.log1p(1000 * total[:, 7] / np.maximum(words, 1))
        out[:, 9] = np.log1p(total[:, 8])
        return out


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def chunks(data: np.ndarray, start: int, end: int, most: int = CHUNK):
    """A long text in parts of about `most` bytes, cut behind white space; a run of that many bytes without any is cut within, between code points."""
    while end - start > most:
        space = np.flatnonzero(_SPACE[data[start + most // 2 : start + most]])
        if len(space):
            cut = start + most // 2 + int(space[-1]) + 1
        else:
            cut = start + most
            while cut > start + 1 and data[cut] & 0xC0 == 0x80:
                cut -= 1
        yield start, cut
        start = cut
    yield start, end


# --- learning ------------------------------------------------------------------------------------------


def beginnings(column: pa.Array):
    """For each text its distinct beginnings of words: yields their hashes, lengths and heads (hashes of the first ROOT[0] code points), and a signature of its word triples."""
    data, offsets = text_buffers(column)
    for k in range(len(column)):
        hashes, lengths, heads, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)], [np.zeros(0, np.uint64)], (1 << 64) - 1
        for first, last in chunks(data, int(offsets[k]), int(offsets[k + 1])):
            r = read(data[first:last], np.array([0, last - first]))
            own = span_hash(r.prefix, r.starts, r.ends)
            if len(own):
                triple = mix(own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:]) if len(own) > 2 else own
                least = min(least, int(triple.min()))
            some = np.sort(np.unique(own, return_index=True)[1])
            some, head = r.beginning(some, ROOT[0])
            for n in range(ROOT[0], ROOT[1] + 1):
                left, found = r.beginning(some, n)
                head, some = head[np.searchsorted(some, left)], left
                found, place = np.unique(found, return_index=True)
                hashes.append(found)
                heads.append(head[place])
                lengths.append(np.full(len(found), n, np.int8))
        keys, place = np.unique(np.concatenate(hashes), return_index=True)
        yield keys, np.concatenate(lengths)[place], np.concatenate(heads)[place], least


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


#: Rows of counts that a task holds before it sends them.
HELD = 1 << 20
COUNTS = "hash long, length int, head long, n long"


def _counts(select):
    """Partial counts of the texts that hold each selected beginning."""

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                for keys, lengths, heads, _ in beginnings(part.column(part.schema.get_field_index("text"))):
                    keep = select(keys)
                    held.append((keys[keep], lengths[keep], heads[keep]))
                if sum(len(x[0]) for x in held) > HELD:
                    yield _counted(held)
                    held = []
        if held:
            yield _counted(held)

    return run


def _counted(held) -> pa.RecordBatch:
    hashes, lengths, heads = (np.concatenate(x) for x in zip(*held))
    keys, place, n = np.unique(hashes, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([_signed(keys), pa.array(lengths[place].astype(np.int32)), _signed(heads[place]), pa.array(n.astype(np.int64))], ["hash", "length", "head", "n"])


def choose_roots(texts: list[np.ndarray], weights: np.ndarray, explained: np.ndarray, length: dict[int, int], clean: dict[int, int]) -> list[int]:
    """Roots (hashes) in the order chosen: each time the one that explains most texts anew, clean texts weighing against it, longer ones first."""
    keys = np.array(sorted({int(h) for t in texts for h in t}), np.uint64)
    if not len(keys):
        return []
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    col = np.searchsorted(keys, np.concatenate(texts))
    cost = CLEAN * np.array([clean.get(int(k), 0) for k in keys], float)
    long = np.array([length[int(k)] for k in keys], float)
    order = np.argsort(col, kind="stable")
    holders = np.split(row[order], np.flatnonzero(np.diff(col[order])) + 1)
    chosen, open_ = [], ~explained
    alone = np.bincount(col, weights=weights[row], minlength=len(keys)) - cost
    while True:
        gain = np.bincount(col, weights=(weights * open_)[row], minlength=len(keys)) - cost
        best = np.lexsort((keys, -long, -np.round(gain, 9)))[0]
        if gain[best] < EXPLAINS:
            break
        chosen.append(int(keys[best]))
        open_[holders[best]] = False
    # roots that stand beside others only: many texts, no clean one, and not within the texts of a root that has been chosen
    sets = [set(holders[int(np.searchsorted(keys, np.uint64(h)))].tolist()) for h in chosen]
    for k in np.lexsort((keys, -long, -np.round(alone, 9))):
        if alone[k] < HOLDS:
            break
        own = set(holders[k].tolist())
        if cost[k] == 0 and not any(own <= other for other in sets):
            sets.append(own)
            chosen.append(int(keys[k]))
    return chosen


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights (the first for no feature), drawn towards PRIOR, by Newton's method."""
    z = np.column_stack([np.ones(len(x)), x.reshape(len(x), len(FEATURES))])
    w, pull = PRIOR.copy(), PRIOR_STRENGTH * np.ones(len(PRIOR))
    loss = lambda v: np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ v)).sum() + 0.5 * (pull * (v - PRIOR) ** 2).sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        slope = z.T @ (p - y) + pull * (w - PRIOR)
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-8:
            break
    return w


def learn_roots(rows: DataFrame) -> list[tuple[int, int, int]]:
    """Insult roots from labelled rows (label, text): hash, length, head. What comes to the driver is bounded by the sample and CANDIDATES."""
    spark = rows.sparkSession
    toxic, clean = rows.filter("label = 1").select("text"), rows.filter("label = 0").select("text")
    seen = toxic.mapInArrow(_counts(lambda keys: np.ones(len(keys), bool)), COUNTS).groupBy("hash").agg(F.min("length").alias("length"), F.min("head").alias("head"), F.sum("n").alias("n"))
    found = seen.filter(F.col("n") >= EXPLAINS).orderBy(F.desc("n"), "hash").limit(CANDIDATES).collect()
    if not found:
        return []
    unsigned = lambda h: h % (1 << 64)
    root = {unsigned(r["hash"]): (unsigned(r["hash"]), r["length"], unsigned(r["head"])) for r in found}
    keys = spark.sparkContext.broadcast(np.array(sorted(root), np.uint64))
    counted = clean.mapInArrow(_counts(lambda x: _among(x, keys.value)), COUNTS).groupBy("hash").agg(F.sum("n").alias("n")).collect()
    against = {unsigned(r["hash"]): r["n"] for r in counted}
    useful = spark.sparkContext.broadcast(np.array(sorted(h for h in (unsigned(r["hash"]) for r in found if r["n"] - CLEAN * against.get(unsigned(r["hash"]), 0) >= EXPLAINS)), np.uint64))
    listed = Grammar(lexicon())

    def held(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column(part.schema.get_field_index("text"))
                known = listed.features(texts)[:, [0, 5]].any(axis=1)
                some = list(beginnings(texts))
                hashes = [x[0][_among(x[0], useful.value)].tobytes() for x in some]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array([x[3] - (1 << 63) for x in some], pa.int64()), pa.array(known)], ["hashes", "signature", "known"])

    got = toxic.mapInArrow(held, "hashes binary, signature long, known boolean").collect()
    got.sort(key=lambda r: (r["signature"], bytes(r["hashes"])))
    alike: dict[int, int] = {}
    for r in got:
        alike[r["signature"]] = alike.get(r["signature"], 0) + 1
    texts = [np.frombuffer(bytes(r["hashes"]), np.uint64) for r in got]
    weights = np.array([1 / alike[r["signature"]] for r in got])
    known = np.array([r["known"] for r in got], bool)
    return [root[h] for h in choose_roots(texts, weights, known, {h: n for h, n, _ in root.values()}, against)]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with score, the probability of label 1.

    Learns from at most train_rows labelled rows whose id is not held out; labels,
    and all columns but the text, are no input of a score. Null labels and labels of
    unknown ids are ignored; of several labels of an id the mean counts, from a half
    up as 1. Without usable labels the listed words and the weights given here score
    alone. Null texts are empty, and an empty text has the score of one without a
    match. Texts of any length are read whole, CHUNK bytes at a time; a word of more
    than half a CHUNK may count as several. All rows and columns of docs are kept, but
    for one named score.
    """
    spark = docs.sparkSession
    docs = docs.drop("score")
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    )
    texts = docs.select(F.col(id_col).alias("__key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # rows that repeat an id would pass the bound
    rows = texts.join(F.broadcast(chosen), F.col("__key") == F.col("__id")).select("label", "text").limit(train_rows)
    rows = written(rows.repartition(max(2, spark.sparkContext.defaultParallelism)), "toxicity-train")
    grammar_ = spark.sparkContext.broadcast(Grammar(lexicon(learn_roots(rows))))

    def features(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values = grammar_.value.features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(values), pa.list_(pa.float64()))], ["label", "features"])

    found = rows.mapInArrow(features, "label int, features array<double>").groupBy("label", "features").count().collect()
    found.sort(key=lambda r: (r["label"], r["features"]))
    times = np.array([r["count"] for r in found], np.int64)
    x = np.repeat(np.array([r["features"] for r in found]).reshape(len(found), len(FEATURES)), times, axis=0)
    weights = spark.sparkContext.broadcast(fit(x, np.repeat(np.array([r["label"] for r in found], float), times)))
    names, at = docs.columns, docs.columns.index(text_col)

    def judge(batches):
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                w = weights.value
                scores = 1 / (1 + np.exp(-np.clip(grammar_.value.features(part.column(at)) @ w[1:] + w[0], -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*names, "score"])

    return docs.mapInArrow(judge, docs.select(*names).schema.add("score", "double"))
