"""A shell for looking into queries: every stage from text to result as a command, in prefix notation.

An expression is a command with its arguments, an integer, a text (from a back-tick to the end of the line) or a variable.
Values go to the variable `_` unless `let` names another.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, TextIO

from pyspark.sql import DataFrame

from quirefold.api import Corpus
from quirefold.lang import lexer, rewrite
from quirefold.lang.parser import MAX_DEPTH, DepthError, EmptyQueryError, compile_tree, parse
from quirefold.lang.tree import CATEGORY_NAMES, Clause
from quirefold.plans.column import select_documents
from quirefold.plans.sql import where
from quirefold.sinks import outputs

#: Fixed value: how deeply expressions may be nested.
STACK_LIMIT = 256

HELP = """help                          this text
exit                          leave
clear                         clear the screen
env [name]                    what the shell runs with
let <name> <value>            keep a value
del [name]                    drop a variable, or all
print [name]                  show a variable, or all
+ - * / <a> <b>               integer arithmetic, division cuts off
len <value>                   characters, tokens, clauses or documents
at <index> <value>            one element; clauses in depth-first order
slice <value> <start> <stop>  elements from start to stop (not included)
rematch <text>                how the scanner cuts a text
repattern                     what the scanner knows
tokenize <text>               text to tokens, e.g. tokenize `author:me
parse <tokens>                tokens to a clause
optimize <level> <clause>     all sound rewrites, so many rounds (0: as deep as the clause, negative: none)
opt <pass,...> <clause>       rewrites by name: """ + ", ".join(rewrite.PASSES) + """
compile <clause>              clause to a condition
execute <condition>           the documents that meet it
query <text>                  execute compile optimize 0 parse tokenize <text>"""


class ShellError(ValueError):
    pass


@dataclass(frozen=True)
class Condition:
    """A compiled clause."""

    tree: Clause

    def __str__(self) -> str:
        return where(self.tree)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def nearest(word: str, words: list[str], ceiling: int = 3) -> str | None:
    """The word that is nearest, if it is nearer than `ceiling`."""
    best = min(words, key=lambda w: edit_distance(word, w), default=None)
    return best if best is not None and edit_distance(word, best) < ceiling else None


def unknown(what: str, word: str, words: list[str]) -> ShellError:
    near = nearest(word, words)
    return ShellError(f"no {what} {word!r}" + (f", did you mean {near!r}?" if near else ""))


class Shell:
    def __init__(self, corpus: Corpus | None = None, out: TextIO = sys.stdout, env: dict[str, str] | None = None) -> None:
        self.corpus, self.out, self.env = corpus, out, env or {}
        self.variables: dict[str, Any] = {}
        self.commands: dict[str, Callable[[], Any]] = {
            "+": self._arithmetic, "-": self._arithmetic, "*": self._arithmetic, "/": self._arithmetic,
            "len": self._len, "at": self._at, "slice": self._slice, "rematch": self._rematch, "repattern": self._repattern,
            "tokenize": lambda: lexer.lex(self._arg(str)), "parse": lambda: parse(self._arg(list)), "optimize": self._optimize,
            "opt": self._opt, "compile": self._compile, "execute": self._execute, "query": self._query,
        }
        self.words: list[str] = []

    # -- reading -------------------------------------------------------------------------------------------------
    @staticmethod
    def split(line: str) -> list[str]:
        head, mark, tail = line.partition("`")
        return [*head.split(), *(["`" + tail] if mark else [])]

    def _next(self, what: str = "a value") -> str:
        if not self.words:
            raise ShellError(f"{what} is missing")
        return self.words.pop(0)

    def _value(self) -> Any:
        if self._depth >= STACK_LIMIT:
            raise ShellError("nested too deeply")
        self._depth += 1
        try:
            word = self._next()
            if word.startswith("`"):
                return word[1:]
            if word.lstrip("-").isdigit():
                return int(word)
            if word in self.commands:
                self._word = word
                return self.commands[word]()
            if word in self.variables:
                return self.variables[word]
            raise unknown("variable or command", word, [*self.variables, *self.commands])
        finally:
            self._depth -= 1

    def _arg(self, kind: type | tuple) -> Any:
        v = self._value()
        if not isinstance(v, kind):
            raise ShellError(f"a {type(v).__name__} where it does not belong")
        return v

    # -- commands ------------------------------------------------------------------------------------------------
    def _arithmetic(self) -> int:
        op = self._word
        a, b = self._arg(int), self._arg(int)
        if op == "/":
            if b == 0:
                raise ShellError("division by zero")
            return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return {"+": a + b, "-": a - b, "*": a * b}[op]

    def _len(self) -> int:
        v = self._value()
        if isinstance(v, str):
            return len(v.encode())
        if isinstance(v, list):
            return len(v)
        if isinstance(v, Clause):
            return v.order()
        if isinstance(v, DataFrame):
            return v.count()
        raise ShellError(f"a {type(v).__name__} has no length")

    def _cut(self, v: Any, start: int, stop: int) -> Any:
        if start < 0 or stop < start:
            raise ShellError("bounds out of range")
        if isinstance(v, DataFrame):
            return Corpus(v).slice(start, stop).docs
        if not isinstance(v, (str, list)):
            raise ShellError(f"a {type(v).__name__} has no parts")
        if stop > len(v):
            raise ShellError("bounds out of range")
        return v[start:stop]

    def _at(self) -> Any:
        index, v = self._arg(int), self._value()
        if isinstance(v, Clause):
            v = list(v.walk())
        part = self._cut(v, index, index + 1)
        return part[0] if isinstance(part, list) else part

    def _slice(self) -> Any:
        v, start, stop = self._value(), self._arg(int), self._arg(int)
        return self._cut(v, start, stop)

    def _rematch(self) -> str:
        return "\n".join(f"{i}: {t}" for i, t in enumerate(lexer.lex(self._arg(str))))

    def _repattern(self) -> str:
        return f"categories: {' '.join(CATEGORY_NAMES)}\noperators: {' '.join(lexer.OPERATORS)}\nstatement: -? category operator (\"text\" | text)\nclause: ( (and|or) statement|clause ... )"

    def _optimize(self) -> Clause:
        level, tree = self._arg(int), self._arg(Clause)
        return rewrite.normalize(tree) if level < 0 else rewrite.optimize(tree, level)

    def _opt(self) -> Clause:
        names = self._next("a pass").split(",")
        tree = self._arg(Clause)
        for n in names:
            if n not in rewrite.PASSES:
                raise unknown("pass", n, list(rewrite.PASSES))
            tree = rewrite.PASSES[n](tree)
        return tree

    def _compile(self) -> Condition:
        tree = self._arg(Clause)
        if tree.depth() > MAX_DEPTH:
            raise DepthError(f"clauses are nested more than {MAX_DEPTH} deep")
        tree = rewrite.normalize(tree)
        if not any(c.statements for c in tree.walk()):
            raise EmptyQueryError("empty query")
        return Condition(tree)

    def _execute(self) -> DataFrame:
        condition = self._arg(Condition)
        if self.corpus is None:
            raise ShellError("no documents to ask")
        return select_documents(self.corpus.docs, condition.tree)

    def _query(self) -> DataFrame:
        if self.words and not self.words[0].startswith("`") and self.words[0] not in self.variables:
            self.words = ["`" + " ".join(self.words)]
        if self.corpus is None:
            raise ShellError("no documents to ask")
        return select_documents(self.corpus.docs, compile_tree(self._arg(str)))

    # -- lines ---------------------------------------------------------------------------------------------------
    def show(self, v: Any) -> str:
        if isinstance(v, DataFrame):
            return "".join(outputs.stream(v)).rstrip("\n") or "No results."
        if isinstance(v, list):
            return lexer.describe(v)
        return v.pretty() if isinstance(v, Clause) else str(v)

    def line(self, text: str) -> bool:
        """Run one line; False if it ends the shell."""
        if text.lstrip().startswith("#") or not text.strip():
            return True
        self.words, self._depth, say = self.split(text), 0, lambda s: print(s, file=self.out)
        head = self.words[0]
        if head == "exit":
            return False
        if head == "help":
            say(HELP)
        elif head == "clear":
            say("\033[2J\033[H")
        elif head in ("env", "print"):
            source = self.env if head == "env" else self.variables
            for name in self.words[1:] or list(source):
                if name not in source:
                    raise unknown("variable", name, list(source))
                say(f"{name} = {self.show(source[name])}")
        elif head == "del":
            for name in self.words[1:] or list(self.variables):
                if self.variables.pop(name, None) is None:
                    raise unknown("variable", name, list(self.variables))
        else:
            name = "_"
            if head == "let":
                self._next()
                name = self._next("a name")
            v = self._value()
            if self.words:
                raise ShellError(f"{self.words[0]!r} is too much")
            self.variables[name] = v
            if head != "let":
                say(self.show(v))
        return True

    def run(self, source: TextIO = sys.stdin) -> None:
        """Lines from a terminal, with a prompt, or from a pipe."""
        prompt = "> " if source.isatty() else ""
        while True:
            if prompt:
                print(prompt, end="", file=self.out, flush=True)
            text = source.readline()
            if not text:
                return
            try:
                if not self.line(text):
                    return
            except ValueError as e:
                print(f"error: {e}", file=self.out)
