"""Tree search: environments, UCT with chance nodes, rollouts, self-play and planning.

A game or plan is a sequential search held in one task; games, plans and the roots of one
plan are independent rows, searched in parallel, and only summaries leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from copy import deepcopy
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.rng import stream


class Environment(Protocol):
    """States are hashable; ``scores`` gives each player's score of a terminal state in [0, 1]."""

    players: int

    def start(self) -> Any: ...
    def legal(self, state) -> Sequence[int]: ...
    def apply(self, state, action: int, g: np.random.Generator) -> Any: ...
    def scores(self, state) -> Sequence[float] | None: ...
    def actor(self, state) -> int: ...


class TicTacToe:
    """Nine cells: 0 empty, 1 and 2 the players' marks."""

    players = 2
    _lines = [(r * 3, r * 3 + 1, r * 3 + 2) for r in range(3)] + [(c, c + 3, c + 6) for c in range(3)] + [(0, 4, 8), (2, 4, 6)]

    def start(self):
        return (0,) * 9

    def legal(self, state):
        return [i for i, v in enumerate(state) if not v]

    def actor(self, state):
        return sum(v != 0 for v in state) % 2

    def apply(self, state, action, g=None):
        return state[:action] + (self.actor(state) + 1,) + state[action + 1 :]

    def scores(self, state):
        for a, b, c in self._lines:
            if state[a] and state[a] == state[b] == state[c]:
                return (1.0, 0.0) if state[a] == 1 else (0.0, 1.0)
        return None if 0 in state else (0.5, 0.5)


@dataclass
class SimulationEnvironment:
    """A re-entrant model as a decision process: ``step(state, action, g)`` returns the next
    state and a reward, for ``horizon`` decisions; the discounted return, scaled from
    [least, most] to [0, 1], is the score."""

    step: Callable[[tuple, int, np.random.Generator], tuple[tuple, float]]
    initial: tuple
    actions: int
    horizon: int
    discount: float = 1.0
    least: float = 0.0
    most: float = 1.0
    players: int = 1

    def start(self):
        return (0, 0.0, self.initial)

    def legal(self, state):
        return range(self.actions)

    def actor(self, state):
        return 0

    def apply(self, state, action, g):
        k, total, inner = state
        inner, reward = self.step(inner, action, g)
        return k + 1, total + self.discount**k * reward, inner

    def scores(self, state):
        if state[0] < self.horizon:
            return None
        return (min(1.0, max(0.0, (state[1] - self.least) / (self.most - self.least))),)


def update_belief(prior: np.ndarray, residuals: np.ndarray, variance: float) -> np.ndarray:
    """Weights of model samples after seeing how far each was off."""
    w = prior * np.exp(-(residuals**2) / (2 * variance))
    return w / w.sum() if w.sum() > 0 else prior


class Mast:
    """Action values over all playouts, for softmax rollouts."""

    def __init__(self, temperature: float = 1.0, prior: float = 0.5):
        self.temperature, self.prior, self.count, self.total = temperature, prior, {}, {}

    def add(self, key, score: float) -> None:
        self.count[key] = self.count.get(key, 0) + 1
        self.total[key] = self.total.get(key, 0.0) + score

    def pick(self, keys: Sequence, g: np.random.Generator) -> int:
        v = np.array([self.total[k] / self.count[k] if k in self.count else self.prior for k in keys]) / self.temperature
        w = np.exp(v - v.max())
        return int(g.choice(len(keys), p=w / w.sum()))


def winner_scores(winner: int, players: int, done: bool) -> tuple[float, ...] | None:
    """Scores of a game whose end names a winner: 1 for them, 0 for the others and, if it names
    none of the players, for all; nothing before the end."""
    return tuple(float(p == winner) for p in range(players)) if done else None


def progress_scores(progress: Callable[[Any, int], float | None], state, players: int) -> tuple[float, ...] | None:
    """Scores of a cut playout by how far each player is, 0 for one of whom nothing is known.
    Nothing known of anyone, or only zeros, tells no action from another and scores nothing."""
    known = [progress(state, p) for p in range(players)]
    return tuple(v or 0.0 for v in known) if any(known) else None


@dataclass
class _Node:
    state: Any
    visits: int = 0
    wins: float = 0.0  # of the player who moved here
    children: dict[int, list["_Node"]] = field(default_factory=dict)
    untried: list[int] | None = None


@dataclass
class Search:
    """UCT. With ``chance`` an action has several outcome nodes, widened as it is visited.

    A playout that is cut before an end is scored by ``progress``, if there is one. Without a
    score its path counts as visited, and no player gets anything.
    """

    env: Any
    simulations: int = 120
    rollout_steps: int = 220
    depth: int = 14
    exploration: float = 1.41
    chance: bool = False
    widen: float = 1.0
    power: float = 0.5
    mast: Mast | None = None
    progress: Callable[[Any, int], float | None] | None = None
    tree: _Node | None = None

    def rollout(self, state, g) -> Sequence[float] | None:
        played = []
        for _ in range(self.rollout_steps):
            legal = list(self.env.legal(state)) if self.env.scores(state) is None else []
            if not legal:
                break
            keys = [(self.env.actor(state), a) for a in legal]
            k = self.mast.pick(keys, g) if self.mast else int(g.integers(len(legal)))
            played.append(keys[k])
            state = self.env.apply(state, legal[k], g)
        s = self.env.scores(state)
        if s is None and self.progress:
            s = progress_scores(self.progress, state, self.env.players)
        if self.mast and s is not None:
            for key in played:
                self.mast.add(key, s[key[0]])
        return s

    def _outcome(self, node: _Node, action: int, g) -> tuple[_Node, bool]:
        known = node.children.setdefault(action, [])
        seen = sum(c.visits for c in known)
        if not known or self.chance and len(known) < math.ceil(self.widen * (seen + 1) ** self.power):
            state = self.env.apply(node.state, action, g)
            for c in known:
                if c.state == state:
                    return c, False
            known.append(_Node(state))
            return known[-1], True
        if len(known) == 1:
            return known[0], False
        w = np.array([c.visits + 1.0 for c in known])
        return known[int(g.choice(len(known), p=w / w.sum()))], False

    def _value(self, node: _Node, action: int) -> float:
        n = sum(c.visits for c in node.children[action])
        return sum(c.wins for c in node.children[action]) / n + self.exploration * math.sqrt(math.log(node.visits) / n)

    def advance(self, action: int, state) -> None:
        """Make the node that ``action`` led to the root, with all that is known below it; an
        outcome that the search never saw starts a new tree."""
        known = self.tree.children.get(action, []) if self.tree else []
        self.tree = next((n for n in known if n.state == state), _Node(state))

    def run(self, state, g: np.random.Generator) -> tuple[int, dict[int, int]]:
        """The best action, by visits, then wins, then chance, and the visits of each. The tree
        of an earlier run is grown further if it has been advanced to this state."""
        root = self.tree if self.tree is not None and self.tree.state == state else _Node(state)
        self.tree = root
        for _ in range(self.simulations):
            node, path = root, [(root, None)]
            for _ in range(self.depth):
                if self.env.scores(node.state) is not None:
                    break
                if node.untried is None:
                    node.untried = list(g.permutation(list(self.env.legal(node.state))))
                if not node.untried and not node.children:
                    break
                actor = self.env.actor(node.state)
                fresh = bool(node.untried)
                action = int(node.untried.pop()) if fresh else max(node.children, key=lambda a: self._value(node, a))
                node, new = self._outcome(node, action, g)
                path.append((node, actor))
                if fresh or new:
                    break
            s = self.rollout(node.state, g)
            for n, actor in path:
                n.visits += 1
                n.wins += s[actor] if actor is not None and s is not None else 0.0
        visits = {a: sum(c.visits for c in cs) for a, cs in root.children.items()}
        wins = {a: sum(c.wins for c in cs) for a, cs in root.children.items()}
        top = max((visits[a], wins[a]) for a in visits)
        ties = [a for a in visits if (visits[a], wins[a]) == top]
        return ties[int(g.integers(len(ties)))], visits


def self_play(spark: SparkSession, env: Callable[[], Any], games: int, *, seed: int = 0, keep: bool = False, **options) -> DataFrame:
    """Games of the search against itself: one row a game with its moves and first score. With
    ``keep`` a move's tree is the start of the next one's."""

    def run(batches):
        for b in batches:
            out = []
            for game in b["id"]:
                e, g = env(), stream(seed, int(game), "game")
                state, moves, search = e.start(), [], Search(e, **deepcopy(options))
                while e.scores(state) is None:
                    action, _ = search.run(state, g)
                    moves.append(action)
                    state = e.apply(state, action, g)
                    search.advance(action, state) if keep else setattr(search, "tree", None)
                out.append((int(game), len(moves), moves, float(e.scores(state)[0])))
            yield pd.DataFrame(out, columns=["game", "n_moves", "moves", "score"])

    return spark.range(games).repartition(max(1, min(games, 1000))).mapInPandas(run, "game long, n_moves int, moves array<int>, score double")


def plan(spark: SparkSession, env: Callable[[], Any], roots: int, *, seed: int = 0, **options) -> DataFrame:
    """Root-parallel planning: searches from one state with their own generators, visits summed
    by action. The action with most visits is the plan's."""
    from pyspark.sql import functions as F

    def run(batches):
        for b in batches:
            out = []
            for r in b["id"]:
                e, g = env(), stream(seed, int(r), "plan")
                _, visits = Search(e, **deepcopy(options)).run(e.start(), g)
                out += [(int(a), int(n)) for a, n in visits.items()]
            yield pd.DataFrame(out, columns=["action", "visits"])

    got = spark.range(roots).repartition(max(1, min(roots, 1000))).mapInPandas(run, "action int, visits long")
    return got.groupBy("action").agg(F.sum("visits").alias("visits"))


def mast_table(plays: DataFrame, key: str, score: str) -> DataFrame:
    """Count, total and mean score per action key of recorded playouts."""
    from pyspark.sql import functions as F

    return plays.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("total")).withColumn("mean", F.col("total") / F.col("n"))
