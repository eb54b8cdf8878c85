"""A left-to-right hidden Markov model of the lines of a page, fitted by Viterbi training.

Observations are a few features of a line, each a small number, taken as
independent given the state.  All pages of a batch are handled at once as arrays
(page, line, state).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STATES = ["top_head", "top_number", "body", "break", "end_head", "end_number"]
KINDS = ["head", "number", "body", "break", "head", "number"]
#: Features and how many values each has: what the letters, the number, the length, the ending and the indent of a line are like.
#: Where on the page a line stands is what the states and their order say; as a feature too it would count twice.
FEATURES = {"letters": 4, "figure": 5, "length": 3, "mark": 2, "indent": 3}
BLANK = -1

# What is taken for granted before any page is seen, as shares; a state that isn't named may not follow.
START = {"top_head": 0.3, "top_number": 0.2, "body": 0.3, "break": 0.2}
_TOP = {"top_head": 0.15, "top_number": 0.15, "body": 0.5, "break": 0.2}
_INSIDE = {"body": 0.8, "break": 0.17, "end_head": 0.015, "end_number": 0.015}
_END = {"end_head": 0.5, "end_number": 0.4, "break": 0.1}
NEXT = {"top_head": _TOP, "top_number": _TOP, "body": _INSIDE, "break": _INSIDE, "end_head": _END, "end_number": _END}
#: Letters: of another kind, those of a clean page, those of a running head, nearly those of one. Figure: none, a page number in words or frames, one in step with the page, a Roman one, a bare one.
SEEN = {
    "head": {"letters": (0.004, 0.000005, 0.94, 0.055995), "figure": (0.9996, 0.0001, 0.0001, 0.0001, 0.0001), "length": (0.5, 0.35, 0.15), "mark": (0.999, 0.001)},
    "number": {"letters": (0.997, 0.001, 0.001, 0.001), "figure": (0.0005, 0.42, 0.5, 0.0785, 0.001), "length": (0.9, 0.08, 0.02), "mark": (0.95, 0.05)},
    "body": {"letters": (0.949, 0.05, 0.0006, 0.0004), "figure": (0.984, 0.0003, 0.0004, 0.0003, 0.015), "length": (0.2, 0.2, 0.6), "mark": (0.97, 0.03)},
    "break": {"letters": (0.997, 0.001, 0.001, 0.001), "figure": (0.996, 0.001, 0.001, 0.001, 0.001), "length": (0.98, 0.01, 0.01), "mark": (0.99, 0.01)},
}
INDENT = (0.8, 0.15, 0.05)
#: Lines that what is taken for granted counts for, in each state.
STRENGTH = 200.0
#: What heads and numbers are known by is held as it is: nothing else in a page says which they are, so these values would follow any mistake.
HELD = ("letters", "figure")


@dataclass
class LineModel:
    start: np.ndarray  # (state)
    step: np.ndarray  # (state, state)
    seen: dict[str, np.ndarray]  # feature: (state, value)

    @classmethod
    def prior(cls) -> LineModel:
        start = np.array([START.get(s, 0.0) for s in STATES])
        step = np.array([[NEXT[a].get(b, 0.0) for b in STATES] for a in STATES])
        seen = {}
        for name in FEATURES:
            seen[name] = np.array([SEEN[kind].get(name, INDENT) for kind in KINDS])
        return cls(start, step, seen)

    def likelihood(self, pages: np.ndarray) -> np.ndarray:
        """(page, line, state): how likely each line is in each state; ones beyond the end of a page."""
        blank, past = pages == BLANK, pages < BLANK
        logs = np.zeros((*pages.shape, len(STATES)))
        rest = np.maximum(pages, 0)
        for name, size in FEATURES.items():
            logs += np.log(self.seen[name] + 1e-12).T[rest % size]
            rest = rest // size
        found = np.exp(logs - logs.max(axis=2, keepdims=True))
        empty = np.array([kind == "break" for kind in KINDS])
        found = np.where(blank[..., None], empty, np.where(empty, 0.0, found))
        return np.where(past[..., None], 1.0, found)

    def counted(self, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Counts of starts, steps and seen values along the likeliest states of pages."""
        size = len(STATES)
        states, there = self.decode(pages), pages > BLANK - 1
        starts = np.bincount(states[there[:, 0], 0], minlength=size).astype(float)
        both = there[:, 1:]
        steps = np.bincount((states[:, :-1] * size + states[:, 1:])[both], minlength=size * size).reshape(size, size).astype(float)
        shown = pages > BLANK
        seen, rest = {}, pages[shown]
        for name, values in FEATURES.items():
            seen[name] = np.bincount(states[shown] * values + rest % values, minlength=size * values).reshape(size, values).astype(float)
            rest = rest // values
        return starts, steps, seen

    def fitted(self, pages: list, rounds: int = 8) -> LineModel:
        """Fitted to pages by Viterbi training, with this model as what is taken for granted.

        Each round decodes the pages and counts along the likeliest paths, until
        the counts stay.  (Summing over all paths, as Baum-Welch does, lets the
        states of heads drift to all short lines at the ends of pages: most pages
        have none, and nothing in a page says so.)
        """
        model, before = self, None
        share = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)
        for _ in range(rounds if pages else 0):
            found = [model.counted(packed([pages[i] for i in some])) for some in batches(pages)]
            starts, steps = sum(f[0] for f in found), sum(f[1] for f in found)
            seen = {name: sum(f[2][name] for f in found) for name in FEATURES}
            if before is not None and np.array_equal(steps, before):
                break
            before = steps
            model = LineModel(share(starts + STRENGTH * self.start), share(steps + STRENGTH * self.step), {name: self.seen[name] if name in HELD else share(counts + STRENGTH * self.seen[name]) for name, counts in seen.items()})
        return model

    def decode(self, pages: np.ndarray) -> np.ndarray:
        """(page, line): the likeliest states (Viterbi)."""
        many, length = pages.shape
        with np.errstate(divide="ignore"):
            here, start, step = (np.log(x) for x in (self.likelihood(pages), self.start, self.step))
        best, came = start + here[:, 0], np.zeros((many, length, len(STATES)), np.int64)
        for t in range(1, length):
            ways = best[:, :, None] + step
            came[:, t] = ways.argmax(axis=1)
            on = pages[:, t] >= BLANK
            came[~on, t] = np.arange(len(STATES))
            best = np.where(on[:, None], ways.max(axis=1) + here[:, t], best)
        found = np.zeros((many, length), np.int64)
        found[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            found[:, t - 1] = came[np.arange(many), t, found[:, t]]
        return found


def packed(pages: list) -> np.ndarray:
    """Pages of codes as one array, with BLANK - 1 beyond their ends."""
    length = max((len(p) for p in pages), default=0)
    made = np.full((len(pages), max(length, 1)), BLANK - 1, np.int64)
    for i, page in enumerate(pages):
        made[i, : len(page)] = page
    return made


def batches(pages: list, most: int = 1 << 17):
    """Row numbers of pages of like length, so that few cells are beyond the ends; at most ``most`` cells at once, or one page."""
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    held: list[int] = []
    for i in order:
        if held and (len(held) + 1) * len(pages[i]) > most:
            yield held
            held = []
        held.append(i)
    if held:
        yield held
