"""State machines over ordered streams: what no window expression can say.

A fold is written once as initial() and step(state, row) -> (state, outputs); states are plain JSON values. batch() runs
it by applyInPandas over each key in order, kinetra.streaming.stateful runs the same class on micro-batches, and a test
holds both to the same rows. One long key is one task by nature of a fold; keys are cut into segments where state resets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Fold:
    """Base: columns read, the output schema, and the machine."""

    columns: list[str] = []
    schema = ""

    def initial(self) -> Any:
        return None

    def step(self, state: Any, row: dict) -> tuple[Any, list[tuple]]:
        raise NotImplementedError

    def finish(self, state: Any) -> list[tuple]:
        """Outputs at the end of a bounded stream."""
        return []

    def rows(self, state: Any, rows: Iterator[dict]) -> tuple[Any, list[tuple]]:
        out: list[tuple] = []
        for row in rows:
            state, more = self.step(state, row)
            out += more
        return state, out


def batch(df: DataFrame, fold: Fold, key: str, order: list[str]) -> DataFrame:
    """key and the fold's outputs for every key, rows in order."""
    kind = dict(df.dtypes)[key]
    names = [key, *[c.strip().split(" ")[0] for c in fold.schema.split(",")]]
    columns = list(dict.fromkeys([key, *order, *fold.columns]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        state, out = fold.rows(fold.initial(), (dict(zip(columns, r, strict=True)) for r in pdf.itertuples(index=False, name=None)))
        out += fold.finish(state)
        return pd.DataFrame([(pdf[key].iloc[0], *o) for o in out], columns=names)

    return df.select(*columns).groupBy(key).applyInPandas(run, f"`{key}` {kind}, {fold.schema}")


class Cadence(Fold):
    """Keeps a row if at least period has passed since the last kept one (not since the last one)."""

    def __init__(self, period: int, t: str = "t", id_: str = "event_id"):
        self.period, self.t, self.id = period, t, id_
        self.columns, self.schema = [t, id_], f"{id_} bigint"

    def step(self, state, row):
        if state is None or row[self.t] - state >= self.period:
            return int(row[self.t]), [(int(row[self.id]),)]
        return state, []


class Coalesce(Fold):
    """Keeps a row if distance, heading (not wrapped), speed or time differ enough from the last kept one."""

    def __init__(self, distance: float, heading: float, speed: float, period: int):
        self.limits = (distance, heading, speed, period)
        self.columns, self.schema = ["t", "x", "y", "heading", "speed", "event_id"], "event_id bigint, reason string"

    def step(self, state, row):
        now = [float(row["x"]), float(row["y"]), float(row["heading"]), float(row["speed"]), int(row["t"])]
        if state is None:
            return now, [(int(row["event_id"]), "first")]
        d, h, v, p = self.limits
        why = None
        if math.hypot(now[0] - state[0], now[1] - state[1]) >= d:
            why = "distance"
        elif abs(now[2] - state[2]) >= h:
            why = "heading"
        elif abs(now[3] - state[3]) >= v:
            why = "speed"
        elif now[4] - state[4] >= p:
            why = "time"
        return (now, [(int(row["event_id"]), why)]) if why else (state, [])


class Pairing(Fold):
    """Pairs two streams one to one: heads within skew are paired and both consumed, else the older head is dropped.

    A queue that outgrows its bound is an error, as is time that does not increase within a side.
    """

    def __init__(self, skew: int, left: str, right: str, side: str = "event_type", bound: int = 4096):
        self.skew, self.sides, self.side, self.bound = skew, (left, right), side, bound
        self.columns, self.schema = ["t", "event_id", side], "left_id bigint, right_id bigint, t bigint"

    def initial(self):
        return [[], []]

    def step(self, state, row):
        if row[self.side] not in self.sides:
            return state, []
        a, b = state
        (a if row[self.side] == self.sides[0] else b).append([int(row["t"]), int(row["event_id"])])
        if max(len(a), len(b)) > self.bound:
            raise ValueError("more rows wait for a partner than the bound allows")
        out = []
        while a and b:
            if abs(a[0][0] - b[0][0]) <= self.skew:
                out.append((a[0][1], b[0][1], max(a[0][0], b[0][0])))
                a.pop(0)
                b.pop(0)
            else:
                (a if a[0][0] < b[0][0] else b).pop(0)
        return [a, b], out


class Mode(Fold):
    """Navigation mode: aided while fixes are accepted, dead reckoning after silence, recovery until enough fixes in a row."""

    def __init__(self, silence: int, needed: int):
        self.silence, self.needed = silence, needed
        self.columns, self.schema = ["t", "event_id", "fix", "accepted"], "event_id bigint, mode string, streak int"

    def initial(self):
        return ["initialising", None, 0]

    def step(self, state, row):
        mode, last, streak = state
        if row["fix"]:
            streak = streak + 1 if row["accepted"] else 0
        if row["fix"] and row["accepted"]:
            if mode in ("dead_reckoning", "recovery"):
                mode = "aided" if streak >= self.needed else "recovery"
            else:
                mode = "aided"
            last = int(row["t"])
        elif last is not None and row["t"] - last >= self.silence:
            mode, streak = "dead_reckoning", 0
        return [mode, last, streak], [(int(row["event_id"]), mode, streak)]


class Recovery(Fold):
    """Whether a fix may restart the filter: after a silence only the second of two fixes in a row that are near each other."""

    def __init__(self, silence: int, near: float):
        self.silence, self.near = silence, near
        self.columns, self.schema = ["t", "event_id", "fix", "x", "y"], "event_id bigint, said string"

    def initial(self):
        return [None, None]

    def step(self, state, row):
        seen, pending = state
        said = "none"
        if row["fix"]:
            at = [float(row["x"]), float(row["y"])]
            if seen is None or row["t"] - seen < self.silence:
                said = "aided"
            elif pending is not None and math.hypot(at[0] - pending[0], at[1] - pending[1]) <= self.near:
                said = "reinitialised"
            else:
                said = "pending"
            seen, pending = (seen, at) if said == "pending" else (int(row["t"]), None)
        return [seen, pending], [(int(row["event_id"]), said)]


class Smoothed(Fold):
    """Exponential average of a heading in degrees, over the shorter way round."""

    def __init__(self, alpha: float):
        self.alpha = alpha
        self.columns, self.schema = ["event_id", "heading"], "event_id bigint, smooth double"

    def step(self, state, row):
        h = float(row["heading"])
        if state is not None:
            h = (state + self.alpha * ((h - state + 540) % 360 - 180)) % 360
        return h, [(int(row["event_id"]), h)]


class Kinematic(Fold):
    """Damped integration of acceleration to speed; stands still where the row says so."""

    def __init__(self, damping: float):
        self.damping = damping
        self.columns, self.schema = ["t", "event_id", "a", "still"], "event_id bigint, speed double"

    def step(self, state, row):
        last, v = state or (int(row["t"]), 0.0)
        dt = (row["t"] - last) / 1e9
        v = 0.0 if row["still"] else max(0.0, (v + float(row["a"]) * dt) * math.exp(-self.damping * dt))
        return [int(row["t"]), v], [(int(row["event_id"]), v)]


class Orientation(Fold):
    """Complementary filter: a quaternion turned by rates and pulled towards gravity where the force is near gravity's."""

    def __init__(self, gain: float, gate: float = 1.5, gravity: float = 9.80665):
        self.gain, self.gate, self.gravity = gain, gate, gravity
        self.columns = ["t", "event_id", "ax", "ay", "az", "gx", "gy", "gz"]
        self.schema = "event_id bigint, qw double, qx double, qy double, qz double"

    def step(self, state, row):
        last, q = state or (int(row["t"]), [1.0, 0.0, 0.0, 0.0])
        dt = min((row["t"] - last) / 1e9, 1.0)
        q = _turn(np.array(q), np.array([row["gx"], row["gy"], row["gz"]], float) * dt)
        force = np.array([row["ax"], row["ay"], row["az"]], float)
        size = np.linalg.norm(force)
        if abs(size - self.gravity) <= self.gate and size > 0:
            up = _matrix(q).T @ np.array([0.0, 0.0, 1.0])
            q = _turn(q, self.gain * np.cross(force / size, up))
        return [int(row["t"]), q.tolist()], [(int(row["event_id"]), *map(float, q))]


class Calibration(Fold):
    """warming, tracking, degraded or recalibrating from a stream of heading evidence.

    Evidence near the running mean confirms it; evidence that keeps far from it for long enough starts a new cluster,
    which takes over once it has enough support. Without evidence for `hold` the state is degraded.
    """

    def __init__(self, near: float, support: int, hold: int):
        self.near, self.support, self.hold = near, support, hold
        self.columns, self.schema = ["t", "event_id", "evidence"], "event_id bigint, state string, mean double"

    def initial(self):
        return {"mean": None, "n": 0, "rival": None, "m": 0, "last": None}

    def step(self, s, row):
        x = row["evidence"]
        if x is not None and not (isinstance(x, float) and math.isnan(x)):
            x, s = float(x), dict(s, last=int(row["t"]))
            if s["mean"] is None or abs(x - s["mean"]) <= self.near:
                n = min(s["n"] + 1, 4 * self.support)
                s.update(mean=x if s["mean"] is None else s["mean"] + (x - s["mean"]) / n, n=n, rival=None, m=0)
            elif s["rival"] is None or abs(x - s["rival"]) > self.near:
                s.update(rival=x, m=1)
            else:
                s.update(m=s["m"] + 1, rival=s["rival"] + (x - s["rival"]) / (s["m"] + 1))
                if s["m"] >= self.support:
                    s.update(mean=s["rival"], n=s["m"], rival=None, m=0)
        if s["last"] is not None and row["t"] - s["last"] > self.hold:
            name = "degraded"
        elif s["m"]:
            name = "recalibrating"
        else:
            name = "tracking" if s["n"] >= self.support else "warming"
        return s, [(int(row["event_id"]), name, s["mean"])]


class Viterbi(Fold):
    """Map matching with bounded lag: candidates of a cycle (rows of equal t), committed when `lag` cycles have followed.

    Scores add emission and transition log likelihoods; a gap or a cycle without a reachable predecessor commits what is
    pending and starts anew. Ties go to the smaller candidate id.
    """

    def __init__(self, lag: int, gap: int, sigma: float):
        self.lag, self.gap, self.sigma = lag, gap, sigma
        self.columns, self.schema = ["t", "edge", "emission", "along"], "t bigint, edge bigint"

    def initial(self):
        return {"layers": [], "open": None}

    def _close(self, s) -> list[tuple]:
        """Adds the open cycle as a layer; returns what it commits."""
        cycle, s["open"] = s["open"], None
        layers, out = s["layers"], []
        nodes = sorted(cycle["nodes"])
        if layers:
            before = layers[-1]
            scored = []
            for edge, emission, along in nodes:
                best = max((p[3] - abs(along - p[2]) / self.sigma, -p[0], i) for i, p in enumerate(before["nodes"]))
                scored.append([edge, emission, along, best[0] + emission, best[2]])
            if cycle["t"] - before["t"] > self.gap or max(n[3] for n in scored) == -math.inf:
                out += self._flush(s)
                layers = s["layers"]
                scored = [[e, m, a, m, -1] for e, m, a in nodes]
        else:
            scored = [[e, m, a, m, -1] for e, m, a in nodes]
        top = max(n[3] for n in scored)
        for n in scored:
            n[3] -= top
        layers.append({"t": cycle["t"], "nodes": scored})
        if len(layers) > self.lag:
            path = self._path(layers)
            out.append((layers[0]["t"], path[0]))
            layers.pop(0)
        return out

    @staticmethod
    def _path(layers) -> list[int]:
        i = max(range(len(layers[-1]["nodes"])), key=lambda k: (layers[-1]["nodes"][k][3], -layers[-1]["nodes"][k][0]))
        path = []
        for layer in reversed(layers):
            path.append(layer["nodes"][i][0])
            i = layer["nodes"][i][4]
        return path[::-1]

    def _flush(self, s) -> list[tuple]:
        layers, s["layers"] = s["layers"], []
        return [(layer["t"], e) for layer, e in zip(layers, self._path(layers), strict=True)] if layers else []

    def step(self, s, row):
        out = []
        if s["open"] is not None and s["open"]["t"] != int(row["t"]):
            out = self._close(s)
        if s["open"] is None:
            s["open"] = {"t": int(row["t"]), "nodes": []}
        s["open"]["nodes"].append([int(row["edge"]), float(row["emission"]), float(row["along"])])
        return s, out

    def finish(self, s):
        out = self._close(s) if s["open"] is not None else []
        return out + self._flush(s)


class RouteProgress(Fold):
    """Distance along a route that never falls; a candidate far behind pays a penalty before the nearest is chosen."""

    def __init__(self, back: float, penalty: float):
        self.back, self.penalty = back, penalty
        self.columns, self.schema = ["event_id", "alongs", "offsets"], "event_id bigint, progress double"

    def step(self, state, row):
        done = state if state is not None else 0.0
        scored = [(float(o) + (self.penalty if float(a) < done - self.back else 0.0), float(a)) for a, o in zip(row["alongs"], row["offsets"], strict=True)]
        best = min(scored)[1] if scored else done
        done = max(done, best)
        return done, [(int(row["event_id"]), done)]


def _turn(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Unit quaternion q after the body rotation vector v."""
    angle = float(np.linalg.norm(v))
    w, xyz = math.cos(angle / 2), v * (math.sin(angle / 2) / angle if angle > 1e-12 else 0.5)
    a, u = q[0], q[1:]
    out = np.concatenate([[a * w - u @ xyz], a * xyz + w * u + np.cross(u, xyz)])
    return out / np.linalg.norm(out)


def _matrix(q: np.ndarray) -> np.ndarray:
    """Body to navigation rotation."""
    w, x, y, z = q
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ])


def skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def matrix_exponential(a: np.ndarray, terms: int = 10) -> np.ndarray:
    """Scaling and squaring of the Taylor series."""
    halvings = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-300)))) + 2)
    x = a / 2**halvings
    out = term = np.eye(len(a))
    for k in range(1, terms + 1):
        term = term @ x / k
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return out


class ErrorState(Fold):
    """15-state error-state filter: position, velocity, attitude, accelerometer and gyroscope bias.

    Rows carry gravity-free body acceleration and rates; a row with a fix also corrects position, behind a gate on the
    normalised innovation. Discretisation is exact for the linear error dynamics (Van Loan), updates are in Joseph form,
    and a step longer than `longest` seconds propagates nothing.
    """

    def __init__(self, accel: float = 0.1, gyro: float = 0.01, bias: float = 1e-3, fix: float = 5.0, gate: float = 11.345, longest: float = 3600.0):
        self.noise, self.bias, self.fix, self.gate, self.longest = (accel, gyro), bias, fix, gate, longest
        self.columns = ["t", "event_id", "ax", "ay", "az", "gx", "gy", "gz", "fix", "px", "py", "pz"]
        self.schema = "event_id bigint, x double, y double, z double, speed double, sigma double, disposition string"

    def initial(self):
        p = np.diag([100.0] * 3 + [10.0] * 3 + [0.1] * 3 + [0.01] * 3 + [0.001] * 3)
        return {"t": None, "p": [0.0] * 3, "v": [0.0] * 3, "q": [1.0, 0.0, 0.0, 0.0], "ba": [0.0] * 3, "bg": [0.0] * 3, "P": p.tolist()}

    def propagate(self, s: dict, accel: np.ndarray, rate: np.ndarray, dt: float) -> dict:
        p, v, q, ba, bg, cov = (np.array(s[k], float) for k in ("p", "v", "q", "ba", "bg", "P"))
        r, a, w = _matrix(q), accel - ba, rate - bg
        f = np.zeros((15, 15))
        f[0:3, 3:6] = np.eye(3)
        f[3:6, 6:9], f[3:6, 9:12] = -r @ skew(a), -r
        f[6:9, 6:9], f[6:9, 12:15] = -skew(w), -np.eye(3)
        q_c = np.diag([0.0] * 3 + [self.noise[0] ** 2] * 3 + [self.noise[1] ** 2] * 3 + [self.bias**2] * 6)
        big = np.zeros((30, 30))
        big[:15, :15], big[:15, 15:], big[15:, 15:] = -f, q_c, f.T
        e = matrix_exponential(big * dt)
        phi = e[15:, 15:].T
        cov = phi @ cov @ phi.T + phi @ e[:15, 15:]
        world = r @ a
        return dict(s, p=(p + v * dt + world * dt * dt / 2).tolist(), v=(v + world * dt).tolist(), q=_turn(q, w * dt).tolist(), P=((cov + cov.T) / 2).tolist())

    def update(self, s: dict, h: np.ndarray, y: np.ndarray, noise: np.ndarray, gate: float) -> tuple[dict, bool]:
        """A linear measurement with innovation y, if it passes the gate on the normalised innovation squared."""
        cov = np.array(s["P"], float)
        innovation = h @ cov @ h.T + noise
        if float(y @ np.linalg.solve(innovation, y)) > gate:
            return s, False
        k = np.linalg.solve(innovation, h @ cov).T
        dx = k @ y
        left = np.eye(15) - k @ h
        cov = left @ cov @ left.T + k @ noise @ k.T
        reset = np.eye(15)
        reset[6:9, 6:9] -= skew(dx[6:9] / 2)
        cov = reset @ cov @ reset.T
        add = lambda name, a: (np.array(s[name]) + dx[a : a + 3]).tolist()
        return dict(s, p=add("p", 0), v=add("v", 3), q=_turn(np.array(s["q"], float), dx[6:9]).tolist(), ba=add("ba", 9), bg=add("bg", 12), P=((cov + cov.T) / 2).tolist()), True

    def correct(self, s: dict, position: np.ndarray) -> tuple[dict, bool]:
        h = np.zeros((3, 15))
        h[:, :3] = np.eye(3)
        return self.update(s, h, position - np.array(s["p"]), np.eye(3) * self.fix**2, self.gate)

    def step(self, s, row):
        t, said = int(row["t"]), "propagated"
        dt = 0.0 if s["t"] is None else (t - s["t"]) / 1e9
        if 0 < dt <= self.longest:
            s = self.propagate(s, np.array([row["ax"], row["ay"], row["az"]], float), np.array([row["gx"], row["gy"], row["gz"]], float), dt)
        elif dt > self.longest:
            said = "gap"
        if row["fix"]:
            s, ok = self.correct(s, np.array([row["px"], row["py"], row["pz"]], float))
            said = "accepted" if ok else "rejected"
        s = dict(s, t=t)
        sigma = math.sqrt(max(0.0, sum(s["P"][i][i] for i in range(3))))
        return s, [(int(row["event_id"]), *s["p"], math.sqrt(sum(x * x for x in s["v"])), sigma, said)]


class Tick(ErrorState):
    """The filter's tick: propagate, then forward speed, yaw, non-holonomic, road and route updates, in this order.

    A null measurement is skipped. Yaw is that of the nose, counter-clockwise from east; a road or route row gives the unit
    normal of its line and the signed distance of the line from the origin along it.
    """

    ORDER = ("forward", "yaw", "nhc", "road", "route")

    def __init__(self, sigmas: dict[str, float], gate: float = 6.63, **more: float):
        super().__init__(**more)
        self.sigmas, self.scalar_gate = sigmas, gate
        self.columns = ["t", "event_id", "ax", "ay", "az", "gx", "gy", "gz", "forward", "yaw", "nhc", "road_nx", "road_ny", "road_at", "route_nx", "route_ny", "route_at"]
        self.schema = "event_id bigint, x double, y double, speed double, updates string"

    def _measured(self, s: dict, kind: str, row: dict) -> tuple[np.ndarray, np.ndarray] | None:
        """(rows of the measurement matrix, innovations), or None if the row has no such measurement."""
        r, h = _matrix(np.array(s["q"], float)), np.zeros((2 if kind == "nhc" else 1, 15))
        body = r.T @ np.array(s["v"])
        given = row["nhc" if kind == "nhc" else kind if kind in ("forward", "yaw") else f"{kind}_at"]
        if given is None or given is False or given != given:
            return None
        if kind in ("forward", "nhc"):
            some = slice(0, 1) if kind == "forward" else slice(1, 3)
            h[:, 3:6], h[:, 6:9] = r.T[some], skew(body)[some]
            return h, (np.array([given]) if kind == "forward" else np.zeros(2)) - body[some]
        if kind == "yaw":
            h[0, 6:9] = r[2]
            return h, np.array([(given - math.atan2(r[1, 0], r[0, 0]) + math.pi) % (2 * math.pi) - math.pi])
        normal = np.array([row[f"{kind}_nx"], row[f"{kind}_ny"], 0.0])
        h[0, :3] = normal
        return h, np.array([given - normal @ np.array(s["p"])])

    def step(self, s, row):
        t, done = int(row["t"]), []
        dt = 0.0 if s["t"] is None else (t - s["t"]) / 1e9
        if 0 < dt <= self.longest:
            s = self.propagate(s, np.array([row["ax"], row["ay"], row["az"]], float), np.array([row["gx"], row["gy"], row["gz"]], float), dt)
            done.append("propagate")
        for kind in self.ORDER:
            found = self._measured(s, kind, row)
            if found is not None:
                h, y = found
                s, ok = self.update(s, h, y, np.eye(len(y)) * self.sigmas[kind] ** 2, self.scalar_gate * len(y))
                done.append(kind if ok else f"{kind} rejected")
        s = dict(s, t=t)
        return s, [(int(row["event_id"]), s["p"][0], s["p"][1], math.sqrt(sum(x * x for x in s["v"])), ",".join(done))]
