"""What a search query asks for, and the stages it is answered by. Plain Python: a query is one short text."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from loomgraph.functions.paths import COMPANIONS, PARSED, STRUCTURAL

#: Word lists that queries are read by.
STOP_WORDS = frozenset("about after and are cite does explain file files flow flows for from how into level path source sources support that the through top what where which with".split())
RELATIONS = frozenset("call called caller callers calls depend dependencies dependency depends dispatch dispatched dispatches dispatching flow flows handoff handoffs owner owns route routed routes through use used uses".split())
FLOW = frozenset("after before finally first flow next pipeline stages then".split())
EVIDENCE_ROLES = frozenset("adapter controller dispatch dispatcher driver entrypoint executor handler indexer parser reader retrieval router runner search service storage store worker writer".split())
STRUCTURES = frozenset("class enum file function interface macro method module namespace route struct trait".split())
FILLERS = frozenset("and are does explain find for from how into the this what when where which why with".split())
ASKING = frozenset("how what where why when explain find".split())
_EXTENSIONS = frozenset(e for table in (PARSED, STRUCTURAL) for own in table.values() for e in own.split()) | set(COMPANIONS)
_BRACKETS = "`'\",;()[]{}"


def normalised(text: str) -> str:
    """Words of a text in lower case, split at camel humps and at everything but letters and digits."""
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)
    text = re.sub(r"([A-Z])([A-Z][a-z])", r"\1 \2", text)
    return re.sub(r"[\W_]+", " ", text).strip().lower()


def query_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(t for t in normalised(query).split() if len(t.encode()) >= 2 and t not in STOP_WORDS))


def quoted_tokens(query: str) -> list[str]:
    """Tokens within backticks or double quotes, which a hit must have all."""
    return list(dict.fromkeys(t for _, inner in re.findall(r"([`\"])(.*?)\1", query) for t in query_tokens(inner)))


def token_weight(frequency: int, documents: int) -> float:
    return min(5.0, max(0.25, 1.0 + math.log((documents + 1) / (frequency + 1))))


def required_matches(tokens: int) -> int:
    """How many of the tokens a hit must have: all of one, two of three, two fifths of more."""
    return tokens if tokens < 2 else 2 if tokens < 4 else (2 * tokens + 4) // 5


def _path_like(token: str) -> bool:
    t = token.strip("`'\",;:()[]")
    if "/" not in t and "\\" not in t:
        return False
    t = t.replace("\\", "/")
    return t.startswith(("/", "./", "../")) or bool(re.match(r"^.:/", t)) or _known_ending(t) or t.count("/") >= 2


def _known_ending(t: str) -> bool:
    return "." in t and t.rsplit("/", 1)[-1].rpartition(".")[2].lower() in _EXTENSIONS


def _qualified(t: str) -> bool:
    return bool(re.search(r"\w(::|\.|#|->)\w", t))


def _camel(t: str) -> bool:
    return bool(re.search(r"[a-z][A-Z]", t))


@dataclass
class Features:
    query: str
    shape: str
    symbol: bool
    path: bool
    prose: bool
    mode: str
    exact_symbols: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    concepts: list[str] = field(default_factory=list)
    relations: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    structures: list[str] = field(default_factory=list)

    @property
    def standalone_path(self) -> bool:
        return self.path and not self.prose and len(self.query.split()) == 1


def classify(query: str) -> Features:
    """The query's shape, by its tokens: symbol_like, path_like, natural_language, or mixed; and what it names."""
    text = query.strip()
    tokens = text.split()
    alone = len(tokens) <= 1
    paths = [t for t in tokens if _path_like(t)]
    others = [t.strip(_BRACKETS) for t in tokens if not _path_like(t)]
    quoted = alone and len(text) > 1 and text[0] == text[-1] and text[0] in "`'\""
    coded = alone and bool(others) and (any(c.isupper() for c in others[0]) or "_" in others[0] or _qualified(others[0]))
    snake = any("_" in t and t == t.lower() for t in others)
    path = bool(paths) or (alone and _known_ending(text))
    symbol = any(_qualified(t) or _camel(t) for t in others) or snake or quoted or coded
    words = [w for t in tokens for w in normalised(t).split()]
    relations = sorted(set(words) & RELATIONS)
    prose = (alone and not path and not symbol) or len(tokens) >= 3 or any(t.lower() in ASKING for t in tokens) or (bool(relations) and not alone)
    shape = "mixed" if prose and (path or symbol) else "path_like" if path else "symbol_like" if symbol else "natural_language"
    flow = bool(relations) and len(words) > 1 and any(w in FLOW for w in words)
    mode = "ordered_flow" if flow else "relation" if relations else "definition" if (symbol or path) and not prose else "explanation"
    named = sorted({t for t in others if _qualified(t) or _camel(t) or "_" in t or quoted})
    roles, structures = sorted(set(words) & EVIDENCE_ROLES), sorted(set(words) & STRUCTURES)
    concepts = sorted({w for w in words if len(w) >= 3} - FILLERS - set(relations) - set(roles) - set(structures))
    return Features(text, shape, symbol, path, prose, mode, named, sorted({p.strip(_BRACKETS).replace("\\", "/") for p in paths}), concepts, relations, roles, structures)


#: Hits shown by shape, windows of the lanes, and lane weights (lexical, semantic, graph) and sublane weights (exact, path, content, symbol) by shape.
TOP_K = {"symbol_like": 12, "path_like": 8, "natural_language": 48, "mixed": 24}
LEXICAL_WINDOW, SEMANTIC_WINDOW = 4096, 64
LANE_WEIGHTS = {"symbol_like": (1.0, 0.5, 1.25), "path_like": (1.25, 0.0, 0.75), "natural_language": (1.0, 1.0, 0.75), "mixed": (1.0, 0.85, 1.0)}
SUBLANE_WEIGHTS = {"symbol_like": (2.0, 0.75, 1.0, 1.5), "path_like": (2.0, 1.25, 1.0, 1.0), "natural_language": (2.0, 1.0, 1.0, 1.25), "mixed": (2.0, 1.0, 1.0, 1.25)}


def plan(features: Features, full: bool = True) -> list[tuple[str, int]]:
    """(stage, how many) in order; nothing where the index is not whole."""
    if not full:
        return []
    k = TOP_K[features.shape]
    stages = [("anchor", min(k, 8))] if features.symbol or features.path else []
    stages.append(("lexical", LEXICAL_WINDOW))
    semantic = [] if features.standalone_path else [("semantic", SEMANTIC_WINDOW)]
    expand = [("expand", min(k, 20 if features.shape == "natural_language" else 16))]
    return stages + (semantic + expand if features.prose else expand + semantic)


@dataclass
class Intent:
    """The free text of a query and its ``field:value`` filters."""

    text: str
    filters: list[tuple[str, str]]


_FIELDS = {"kind": "kind", "path": "path", "file": "path", "name": "name", "symbol": "name", "lang": "language", "language": "language"}


def parse_intent(query: str) -> Intent:
    """Filters taken out of a query. Without free text the names asked for are the text, else all values."""
    free, filters = [], []
    for token in query.split():
        name, colon, value = token.partition(":")
        known = _FIELDS.get(name.lower())
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'`":
            value = value[1:-1]
        if not colon or not known or not value:
            free.append(token)
        else:
            filters.append((known, value))
    names = [v for f, v in filters if f == "name"]
    text = free or names or [v for _, v in filters]
    return Intent(" ".join(text) or query.strip(), filters)
