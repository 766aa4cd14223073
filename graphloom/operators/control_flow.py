"""Control-flow graphs of Python functions, as the rows that program dependence and taint read.

One visitor for each language plugs in as a function of (path, content); this one reads Python's own syntax tree. A function
gives blocks from 0 (entry) to n - 1 (exit), edges with their kinds, and a fact for each statement: what it defines, uses, and
may define (through an attribute or an item). Jumps that leave a try with a finally go through the finally's blocks and leave
those with a finally- kind.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import plug_in

_PLACE = "array<struct<block:int,line:int,kind:string>>"
CFG_TYPE = f"fn string, n int, entry int, exit int, edges array<struct<src:int,dst:int,kind:string>>, facts array<struct<block:int,line:int,defs:array<string>,uses:array<string>,may:array<string>>>, sources {_PLACE}, sinks {_PLACE}, cleans {_PLACE}"
Loose = list[tuple[int, str]]  # edges whose target is not there yet


class _Loop:
    """Where continue goes, and the edges of its breaks."""

    def __init__(self, head: int):
        self.head, self.breaks = head, []


class _Finally:
    """Jumps that wait for a finally: (block, kind) by the kind of the jump."""

    def __init__(self):
        self.jumps: dict[str, Loose] = {}


class _Handlers:
    """Blocks that may throw into the handlers of a try."""

    def __init__(self):
        self.blocks: list[int] = []


class Graph:
    """The graph of one function."""

    def __init__(self, node: ast.FunctionDef | ast.AsyncFunctionDef):
        self.edges: list[tuple[int, int, str]] = []
        self.facts: list[tuple[int, int, list[str], list[str], list[str]]] = []
        self.count, self.frames, self.to_exit = 0, [], []
        entry = self._block([])
        args = node.args
        names = [a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]]
        if names:
            self.facts.append((entry, node.lineno, names, [], []))
        loose = self._run(node.body, [(entry, "seq")])
        self.exit = self.count
        self.edges += [(b, self.exit, k) for b, k in loose + self.to_exit]

    def _block(self, into: Loose) -> int:
        b = self.count
        self.count += 1
        self.edges += [(a, b, k) for a, k in into]
        for f in reversed(self.frames):
            if isinstance(f, _Handlers):
                f.blocks.append(b)
                break
        return b

    def _fact(self, block: int, line: int, *nodes: ast.AST | None) -> None:
        defs, uses, may = [], [], []
        for top in filter(None, nodes):
            for x in _own(top):
                if isinstance(x, ast.Name):
                    (uses if isinstance(x.ctx, ast.Load) else defs).append(x.id)
                elif isinstance(x, (ast.Attribute, ast.Subscript)) and isinstance(x.ctx, ast.Store) and isinstance(x.value, ast.Name):
                    may.append(x.value.id)
                elif isinstance(x, (ast.Import, ast.ImportFrom)):
                    defs += [(a.asname or a.name).split(".")[0] for a in x.names]
                elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    defs.append(x.name)
                elif isinstance(x, ast.ExceptHandler) and x.name:
                    defs.append(x.name)
                elif isinstance(x, (ast.MatchAs, ast.MatchStar)) and x.name:
                    defs.append(x.name)
            if isinstance(top, ast.AugAssign) and isinstance(top.target, ast.Name):
                uses.append(top.target.id)
        unique = lambda names: list(dict.fromkeys(names))
        if defs or uses or may:
            self.facts.append((block, line, unique(defs), unique(uses), unique(may)))

    def _jump(self, block: int, kind: str) -> None:
        """return, break, continue or throw: to its target, or to the finally that it must cross."""
        for f in reversed(self.frames):
            if isinstance(f, _Finally):
                f.jumps.setdefault(kind, []).append((block, kind))
                return
            if isinstance(f, _Loop) and kind in ("break", "continue"):
                self._land(f, [(block, kind)], kind)
                return
            if isinstance(f, _Handlers) and kind == "throw":
                return  # its block is among those that throw into the handlers
        self.to_exit.append((block, kind))

    def _land(self, loop: _Loop, loose: Loose, kind: str) -> None:
        if kind == "break":
            loop.breaks += loose
        else:
            self.edges += [(b, loop.head, k) for b, k in loose]

    def _run(self, body: list[ast.stmt], loose: Loose) -> Loose:
        """The statements behind the loose edges; gives the loose edges behind them."""
        block: int | None = None
        for s in body:
            if block is None:
                if not loose and body[0] is not s:  # behind a jump
                    return []
                block, loose = self._block(loose), []
            visit = getattr(self, f"_on_{type(s).__name__.lower().removeprefix('async')}", None)
            if visit is not None:
                loose, block = visit(s, block), None
            elif isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
                self._fact(block, s.lineno, s)
                self._jump(block, {"Return": "return", "Raise": "throw", "Break": "break", "Continue": "continue"}[type(s).__name__])
                loose, block = [], None
            else:
                self._fact(block, s.lineno, s)
        return loose if block is None else [(block, "seq")]

    def _on_if(self, s: ast.If, block: int) -> Loose:
        self._fact(block, s.lineno, s.test)
        return self._run(s.body, [(block, "cond-true")]) + self._run(s.orelse, [(block, "cond-false")])

    def _loop(self, s: ast.While | ast.For, block: int, *told: ast.AST) -> Loose:
        loop = _Loop(self._block([(block, "seq")]))
        self._fact(loop.head, s.lineno, *told)
        self.frames.append(loop)
        self.edges += [(b, loop.head, "loop-back") for b, _ in self._run(s.body, [(loop.head, "cond-true")])]
        self.frames.pop()
        forever = isinstance(s, ast.While) and isinstance(s.test, ast.Constant) and bool(s.test.value)
        return ([] if forever else self._run(s.orelse, [(loop.head, "cond-false")])) + loop.breaks

    def _on_while(self, s: ast.While, block: int) -> Loose:
        return self._loop(s, block, s.test)

    def _on_for(self, s: ast.For, block: int) -> Loose:
        return self._loop(s, block, s.iter, s.target)

    def _on_with(self, s: ast.With, block: int) -> Loose:
        self._fact(block, s.lineno, *(x for i in s.items for x in (i.context_expr, i.optional_vars)))
        return self._run(s.body, [(block, "seq")])

    def _on_match(self, s: ast.Match, block: int) -> Loose:
        self._fact(block, s.lineno, s.subject)
        out: Loose = []
        loose: Loose = [(block, "seq")]
        for case in s.cases:  # one pattern is tried behind the other
            head = self._block(loose)
            self._fact(head, case.pattern.lineno, case.pattern, case.guard)
            out += self._run(case.body, [(head, "switch-case")])
            every = case.guard is None and isinstance(case.pattern, ast.MatchAs) and case.pattern.pattern is None
            loose = [] if every else [(head, "cond-false")]
        return out + loose

    def _on_try(self, s: ast.Try, block: int) -> Loose:
        end, caught = _Finally() if s.finalbody else None, _Handlers()
        if end:
            self.frames.append(end)
        if s.handlers:
            self.frames.append(caught)
        loose = self._run(s.body, [(block, "seq")])
        if s.handlers:
            self.frames.pop()
        loose = self._run(s.orelse, loose)
        for h in s.handlers:
            head = self._block([(b, "throw") for b in dict.fromkeys(caught.blocks)])
            self._fact(head, h.lineno, ast.ExceptHandler(h.type, h.name, []))
            loose += self._run(h.body, [(head, "seq")])
        if not end:
            return loose
        self.frames.pop()
        waiting = [e for es in end.jumps.values() for e in es]
        done = self._run(s.finalbody, loose + waiting)
        for kind in end.jumps if done else ():
            told = [(b, kind if kind == "throw" else f"finally-{kind}") for b, _ in done]
            self._resume(kind, told)
        return done if loose else []

    _on_trystar = _on_try

    def _resume(self, kind: str, loose: Loose) -> None:
        """A jump goes on behind a finally: to its target, or to the next finally."""
        for f in reversed(self.frames):
            if isinstance(f, _Finally):
                f.jumps.setdefault(kind, []).extend(loose)
                return
            if isinstance(f, _Loop) and kind in ("break", "continue"):
                self._land(f, loose, kind)
                return
            if isinstance(f, _Handlers) and kind == "throw":
                f.blocks += [b for b, _ in loose]
                return
        self.to_exit += loose


def _own(top: ast.AST) -> Iterator[ast.AST]:
    """The nodes of a statement or expression without those inside nested functions and classes."""
    yield top
    if isinstance(top, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
        return
    for child in ast.iter_child_nodes(top):
        yield from _own(child)


def functions(path: str, content: str) -> list[tuple]:
    """Rows of CFG_TYPE, one for each function of a source, nested ones and methods too."""
    out = []

    def visit(node: ast.AST, name: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                g = Graph(child)
                out.append((f"{path}:{name}{child.name}:{child.lineno}", g.exit + 1, 0, g.exit, g.edges, g.facts, [], [], []))
            inner = f"{name}{child.name}." if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else name
            visit(child, inner)

    visit(ast.parse(content), "")
    return out


def python_cfgs(files: DataFrame) -> DataFrame:
    """CFG rows of all functions in Python files (path, content); a file that does not parse gives none."""
    return plug_in(files.filter(F.col("path").endswith(".py")), functions, CFG_TYPE)
