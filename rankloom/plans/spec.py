"""What a ranking query is asked for: weights, filters, minimums, comparison; immutable, with its URL form and presets."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import parse_qsl, urlencode

CATEGORIES = ("transport", "rent", "daily_essentials", "safety", "food", "green", "gym_sports", "vibe", "nightlife", "crowd")
#: Weights by default, and the order in which nine values of an old link come.
DEFAULT_WEIGHTS = {"transport": 18, "rent": 18, "daily_essentials": 14, "safety": 10, "food": 12, "green": 8, "gym_sports": 4, "vibe": 4, "nightlife": 8, "crowd": 4}
LEGACY_ORDER = ("food", "nightlife", "transport", "rent", "safety", "green", "gym_sports", "vibe", "crowd", "daily_essentials")
RENT_RANGE, COMMUTE_RANGE, MINIMUM_CHOICES, MAX_COMPARE = (80_000, 300_000), (10, 60), (5, 6, 7, 8), 3


@dataclass(frozen=True)
class Filters:
    min_rent: float = RENT_RANGE[0]
    max_rent: float = RENT_RANGE[1]
    min_commute: float = COMMUTE_RANGE[0]
    max_commute: float = COMMUTE_RANGE[1]
    minimums: dict[str, float] = field(default_factory=dict)
    camera: bool = False

    @property
    def none(self) -> bool:
        return self == Filters()


@dataclass(frozen=True)
class QuerySpec:
    weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    filters: Filters = Filters()
    selected: str | None = None
    compare: tuple[str, ...] = ()
    heatmap: bool = False
    dimension: str = "composite"
    hide_flood: bool = False
    hide_seismic: bool = False

    def with_weight(self, category: str, weight: float) -> QuerySpec:
        return replace(self, weights={**self.weights, category: weight})

    def with_filters(self, **changes) -> QuerySpec:
        return replace(self, filters=replace(self.filters, **changes))

    def with_compared(self, key: str) -> QuerySpec:
        """Adds a key to compare; the fourth and repeated ones are refused."""
        if key in self.compare or len(self.compare) >= MAX_COMPARE:
            return self
        return replace(self, compare=(*self.compare, key))

    def without_compared(self, key: str) -> QuerySpec:
        return replace(self, compare=tuple(k for k in self.compare if k != key))

    def with_minimum(self, category: str, value: float | None) -> QuerySpec:
        """A category's minimum, or none; one that is set anew keeps its place among the others."""
        others = {k: v for k, v in self.filters.minimums.items() if k != category}
        return self.with_filters(minimums=others if value is None else {**self.filters.minimums, category: value})

    def with_preset(self, name: str) -> QuerySpec:
        """The preset's weights; filters are reset before its own are set."""
        weights, changes = PRESETS[name]
        return replace(self, weights=dict(weights), filters=replace(Filters(), **changes))

    def hydrated(self, part: dict) -> QuerySpec:
        """This with what a link names: whole weights, single filters, minimums added to those there are."""
        filters = dict(part.get("filters", {}))
        if "minimums" in filters:
            filters["minimums"] = {**self.filters.minimums, **filters["minimums"]}
        return replace(self, weights=part.get("weights", self.weights), filters=replace(self.filters, **filters), selected=part.get("selected", self.selected), compare=tuple(part.get("compare", self.compare))[:MAX_COMPARE], heatmap=part.get("heatmap", self.heatmap), dimension=part.get("dimension", self.dimension))


def _weights(**given: float) -> dict[str, float]:
    return {c: given.get(c, 0) for c in CATEGORIES}


#: Weights and filters of the four profiles.
PRESETS: dict[str, tuple[dict[str, float], dict]] = {
    "young-pro": (_weights(transport=28, rent=18, daily_essentials=12, food=12, vibe=12, nightlife=18), {"max_rent": 150_000, "max_commute": 30}),
    "family": (_weights(transport=12, rent=8, daily_essentials=20, safety=25, green=20, crowd=15), {"max_commute": 40, "minimums": {"safety": 7}}),
    "foodie-budget": (_weights(rent=30, daily_essentials=14, food=30, vibe=13, nightlife=13), {"max_rent": 120_000}),
    "digital-nomad": (_weights(transport=8, rent=17, daily_essentials=15, food=17, gym_sports=8, vibe=22, crowd=13), {"max_rent": 130_000}),
}


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def encode(spec: QuerySpec) -> str:
    """The query string; only what differs from the defaults."""
    out: list[tuple[str, str]] = []
    if any(spec.weights[c] != DEFAULT_WEIGHTS[c] for c in CATEGORIES):
        out.append(("w", ",".join(_number(spec.weights[c]) for c in CATEGORIES)))
    f = spec.filters
    limits = (("nr", f.min_rent, f.min_rent > RENT_RANGE[0]), ("mr", f.max_rent, f.max_rent < RENT_RANGE[1]), ("nc", f.min_commute, f.min_commute > COMMUTE_RANGE[0]), ("mc", f.max_commute, f.max_commute < COMMUTE_RANGE[1]))
    out += [(k, _number(v)) for k, v, differs in limits if differs]
    if f.minimums:
        out.append(("cm", ",".join(f"{k}:{_number(v)}" for k, v in f.minimums.items())))
    if f.camera:
        out.append(("lc", "1"))
    if spec.selected:
        out.append(("s", spec.selected))
    if spec.compare:
        out.append(("c", ",".join(spec.compare)))
    if spec.heatmap:
        out.append(("hm", "1"))
    if spec.dimension != "composite":
        out.append(("hd", spec.dimension))
    return urlencode(out)


def _float(text: str) -> float | None:
    try:
        return float(text.strip() or 0)
    except ValueError:
        return None


def decode(query: str) -> dict:
    """What a query string names and is valid; values out of range or that aren't numbers are left out."""
    given, part = dict(parse_qsl(query.lstrip("?"))), {}
    values = [_float(v) for v in given.get("w", "").split(",")] if given.get("w") else []
    if len(values) >= 9 and None not in values:
        order = LEGACY_ORDER if len(values) < len(CATEGORIES) else CATEGORIES
        part["weights"] = {**DEFAULT_WEIGHTS, **dict(zip(order, values))}
    filters: dict = {}
    for key, name, (low, high) in (("nr", "min_rent", RENT_RANGE), ("mr", "max_rent", RENT_RANGE), ("nc", "min_commute", COMMUTE_RANGE), ("mc", "max_commute", COMMUTE_RANGE)):
        v = _float(given[key]) if given.get(key) else None
        if v is not None and low <= v <= high:
            filters[name] = v
    minimums = {}
    for pair in given.get("cm", "").split(","):
        name, _, text = pair.partition(":")
        v = _float(text) if text else None
        if name in CATEGORIES and v is not None and 1 <= v <= 10:
            minimums[name] = v
    if minimums:
        filters["minimums"] = minimums
    if given.get("lc") == "1":
        filters["camera"] = True
    if filters:
        part["filters"] = filters
    if given.get("s"):
        part["selected"] = given["s"]
    if given.get("c"):
        part["compare"] = [x for x in given["c"].split(",") if x]
    if given.get("hm") == "1":
        part["heatmap"] = True
    if given.get("hd"):
        part["dimension"] = given["hd"]
    return part


def share_url(base: str, spec: QuerySpec) -> str:
    query = encode(spec)
    return f"{base}?{query}" if query else base


def reduced(spec: QuerySpec, action: str, name: str | None = None, value: str | None = None) -> QuerySpec:
    """The query after one action of a user; unknown actions, categories and limits, and values that aren't numbers where these are needed, change nothing."""
    number = None if value is None else _float(value)
    if action == "weight" and name in CATEGORIES and number is not None:
        return spec.with_weight(name, number)
    if action == "weights" and value and len(given := [_float(v) for v in value.split(",")]) == len(CATEGORIES) and None not in given:
        return replace(spec, weights=dict(zip(CATEGORIES, given)))
    if action == "reset_weights":
        return replace(spec, weights=dict(DEFAULT_WEIGHTS))
    if action == "filter" and name in ("min_rent", "max_rent", "min_commute", "max_commute") and number is not None:
        return spec.with_filters(**{name: number})
    if action == "minimum" and name in CATEGORIES and (value is None or number is not None):
        return spec.with_minimum(name, number)
    if action == "camera":
        return spec.with_filters(camera=value == "true")
    if action == "reset_filters":
        return replace(spec, filters=Filters())
    if action == "preset" and name in PRESETS:
        return spec.with_preset(name)
    if action == "select":
        return replace(spec, selected=value or None)
    if action == "compare" and value:
        return spec.with_compared(value)
    if action == "uncompare" and value:
        return spec.without_compared(value)
    if action == "clear_compare":
        return replace(spec, compare=())
    if action in ("heatmap", "hide_flood", "hide_seismic"):
        return replace(spec, **{action: value == "true"})
    if action == "dimension" and value:
        return replace(spec, dimension=value)
    if action == "hydrate":
        return spec.hydrated(decode(value or ""))
    return spec


def dumped(spec: QuerySpec) -> str:
    return json.dumps(asdict(spec))


def loaded(text: str) -> QuerySpec:
    given = json.loads(text)
    return QuerySpec(**{**given, "filters": Filters(**given["filters"]), "compare": tuple(given["compare"])})
