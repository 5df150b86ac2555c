import textwrap
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.operators.definitions import HEADS, definitions


def told(language, text):
    return [(d.symbol, d.first, d.last, d.summary) for d in definitions(language, textwrap.dedent(text).lstrip("\n"))]


# One sample a language: definitions with documentation, nested ones, and code that only looks like a definition.
SAMPLES = {
    "rust": (
        """
        //! Sums and stacks.
        use std::fmt;

        /// Adds two numbers.
        /// Wraps around.
        pub fn add(a: u8, b: u8) -> u8 {
            let s = "fn no() {"; let c = '{';
            a + b
        }
        pub(crate) const LIMIT: usize = 3;

        /** Keeps `T`s. */
        pub struct Stack<T> {
            items: Vec<T>,
        }
        impl<T> Stack<T> {
            fn push(&mut self) {}
        }
        impl fmt::Display for Stack<u8> {}
        impl Plain { /* /* nested */ } */ }
        /// Squares.
        macro_rules! square { ($x:expr) => { $x * $x }; }
        #[cfg(test)]
        mod tests { fn t() {} }
        """,
        [("add", 5, 8, "Adds two numbers.\nWraps around."), ("LIMIT", 9, 9, None), ("Stack", 12, 14, "Keeps `T`s."), ("", 15, 17, None),
         ("", 18, 18, None), ("Plain", 19, 19, None), ("square", 21, 21, None), ("tests", 23, 23, None)],
    ),
    "python": (
        '''
        import re

        # Reads the arguments,
        # all of them.
        def parse(argv: dict = {"a": ":"},
                  more=None):
            x = """
        def no(): pass
        """
            return argv


        class Ring(Base):
            """A buffer.

                Full: overwrites.
            """

            def push(self): pass


        if True:
            @wraps(f)
            async def hidden(
                a,
                b,
            ) -> int:
                \'\'\'Says it.\'\'\'
                return 1
        ''',
        [("parse", 4, 9, "Reads the arguments,\nall of them."), ("Ring", 12, 18, "A buffer.\n\nFull: overwrites."), ("hidden", 22, 28, "Says it.")],
    ),
    "go": (
        """
        package p

        // Greet says hello.
        func Greet(n string) string {
        	return `}` + n
        }

        type (
        	A int
        )

        // Set keeps.
        type Set[K comparable] struct {
        	m map[K]bool
        }

        // Add puts.
        /* And more. */
        func (s *Set[K]) Add(k K) { s.m[k] = true }

        const X = 1
        var y, z = 2, 3
        """,
        [("Greet", 3, 5, "Greet says hello."), ("", 7, 9, None), ("Set", 12, 14, None), ("Add", 18, 18, "Add puts.\nAnd more."), ("X", 20, 20, None), ("y", 21, 21, None)],
    ),
    "java": (
        """
        package a;
        import b.C;

        /**
         * A point.
         *
         * Two numbers.
         */
        @Entity(name = "x{")
        public final class Point<T extends C> implements D {
            /** Not a chunk. */
            int f() { return 1; }
        }
        // plain
        enum E { A, B }
        /** Area. */
        static double area(double r) {
            return r;
        }
        public @interface Mark { }
        """,
        [("Point", 8, 12, "A point.\nTwo numbers."), ("E", 14, 14, None), ("area", 16, 18, "Area."), ("Mark", 19, 19, None)],
    ),
    "csharp": (
        '''
        using System;
        namespace A.B
        {
            /// <summary>A heap.</summary>
            /// <typeparam name="T">kind</typeparam>
            [Serializable]
            public sealed partial class Heap<T> : IHeap where T : new()
            {
                string s = @"}""";
            }

            /// <summary>Only a kind.</summary>
            public enum Kind { A, B }
            public delegate int Pick(int a);
            namespace C { internal record struct R(int X); }
        }
        ''',
        [("Heap", 5, 9, "A heap.\nkind"), ("Kind", 12, 12, None), ("Pick", 13, 13, None), ("R", 14, 14, None)],
    ),
    "javascript": (
        """
        import x from 'y';
        /** Waits. */
        export default async function debounce(fn, ms = 3) {
          return (...a) => { fn(`}${a}`) }
        }
        /** Adds. */
        export const add = (a, b) =>
          a + b;
        // plain
        const twice = x => add(x, x), re = /[/}]{/;
        /** Lost. */
        const three = 3;
        class A extends B { m() {} }
        module.exports = { /** Runs. */ run(a) { if (a) { b() } }, walk: async (a) => { } };
        describe("x", () => { it("y", function () { }) });
        function* gen() {}
        """,
        [("debounce", 2, 4, "Waits."), ("add", 6, 7, "Adds."), ("twice", 9, 9, None), ("A", 12, 12, None), ("run", 13, 13, "Runs."), ("walk", 13, 13, None),
         ("", 14, 14, None), ("gen", 15, 15, None)],
    ),
    "typescript": (
        """
        export type Result<T> =
          | { ok: true; value: T }
          | { ok: false };

        /** Checks. */
        export function valid(a: string): a is Email {
          return /^[^@]+@{1}/.test(a);
        }
        namespace N {
          /** A user. */
          export interface User { id: number; f(): void }
          const enum K { A }
        }
        /** Finds. */
        export const find = <T>(a: T[], f: (x: T) => boolean): { x?: T } => {
          return { x: a.find(f) };
        };
        @Injectable({ a: "(" })
        export abstract class Q { }
        """,
        [("Result", 0, 2, None), ("valid", 5, 7, "Checks."), ("User", 10, 10, "A user."), ("K", 11, 11, None), ("find", 14, 16, "Finds."), ("Q", 17, 18, None)],
    ),
    "tsx": (
        """
        type Props = { n: number };
        /** Counts. */
        export function Counter({ n }: Props) {
          return <div onClick={() => f(n)}>{n} isn't {"}"}</div>;
        }
        """,
        [("Props", 0, 0, None), ("Counter", 2, 4, "Counts.")],
    ),
    "kotlin": (
        """
        package a
        import b.c

        /** A vector. */
        data class V(val x: Int,
                     val y: Int) {
            fun len() = x
        }

        /** How far. */
        @JvmStatic
        fun <T> List<T>.far(a: V): Int =
            a.x +
                a.y

        val z: Int
            get() = 1
        // plain
        object O { }
        typealias P = V
        """,
        [("V", 4, 7, "A vector."), ("far", 10, 13, "How far."), ("z", 15, 16, None), ("O", 18, 18, None), ("P", 19, 19, None)],
    ),
    "scala": (
        """
        package a {
          /** A ratio. */
          final case class R(n: Int)(implicit d: D)
            extends B
            with C {
            def x = 1
          }
          /** Not told. */
          object R { val q = "}" }
          /** Squares. */
          private[a] def sq(n: Int): Int =
            n * n
          given ord: Ordering[R] = x
        }
        """,
        [("R", 2, 6, "A ratio."), ("R", 8, 8, None), ("sq", 10, 11, "Squares."), ("ord", 12, 12, None)],
    ),
    "ruby": (
        """
        # frozen
        require 'a'

        # Camels.
        # A lot.
        def camel(s)
          s.map do |x|
            if x then y end
          end
        end

        module M
          def self.f; 1; end
        end
        def sq(x) = x * x
        """,
        [("camel", 5, 9, "Camels.\nA lot."), ("M", 11, 13, None), ("sq", 14, 14, None)],
    ),
    "haskell": (
        """
        module M where
        import A

        -- | Chooses.
        choose :: Int
               -> Int
        choose n
          | n > 0 = 1
          | otherwise = 2

        {-| A tree. -}
        data T a = L | N (T a)
        class C a where
          c :: a
        -- plain
        compress [] = []
        compress (x:xs) = go x where
          go = id
        """,
        [("choose", 6, 8, "Chooses."), ("T", 11, 11, None), ("C", 12, 13, None), ("compress", 15, 15, None), ("compress", 16, 17, None)],
    ),
    "fsharp": (
        """
        module Numerics

        open System

        /// Powers.
        let rec pow (b: int) e =
            match e with
            | 0 -> 1
            | _ -> b * pow b (e - 1) (* nested (* *) *)

        /// A shape.
        type Shape =
            | Dot
            | Line of int
        /// Not told.
        module Inner =
            let hidden = 1
        """,
        [("pow", 5, 8, "Powers."), ("Shape", 11, 13, "A shape."), ("Inner", 15, 16, None)],
    ),
}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_definitions(language):
    text, expected = SAMPLES[language]
    assert told(language, text) == expected


@pytest.mark.parametrize("language, text", [
    ("haskell", "-- x\nf = 1"), ("rust", "// x\nfn f() {}"), ("java", "// x\nclass A {}"), ("javascript", "// x\nfunction f() {}"), ("typescript", "/* x */\nfunction f() {}"),
    ("scala", "// x\ndef f = 1"), ("csharp", "// x\nclass A {}"), ("fsharp", "// x\nlet f = 1"), ("kotlin", "/* x */\nfun f() {}"),
])
def test_ordinary_comment_is_no_summary_and_parts_others(language, text):
    assert [d.summary for d in definitions(language, text)] == [None]
    mark = {"haskell": "-- | Doc", "rust": "/// Doc", "csharp": "/// Doc", "fsharp": "/// Doc"}.get(language, "/** Doc */")
    assert [d.summary for d in definitions(language, f"{mark}\n\n{text}")] == [None]
    assert [d.summary for d in definitions(language, text.replace(text.split("\n")[0], f"{mark}\n", 1))] == ["Doc"]


def test_a_comment_has_one_marker():
    assert told("haskell", "-- | One\n--   two\nf = 1") == [("f", 2, 2, "One\n--   two")]
    assert told("java", "/** ** a\n *\n * b * */\nclass A {}") == [("A", 3, 3, "* a\nb *")]


@pytest.mark.parametrize("language", sorted(HEADS))
def test_any_nesting(language):
    core = "(" * 20_000 + "1" + ")" * 20_000
    assert all(d.first == 0 for d in definitions(language, f"x = {core}\n"))
    assert isinstance(definitions(language, "{" * 20_000), list)


@settings(max_examples=150, deadline=None)
@given(st.text("ab\n{}()=># \t\"'/*-", max_size=80) | st.lists(st.sampled_from("def fn class f ( ) { } = => \n : ; , // /* */ ' \" let type end".split(" ")), max_size=30).map(" ".join), st.sampled_from(sorted(HEADS)))
def test_definitions_never_fail_and_never_overlap(text, language):
    found = definitions(language, text)
    assert all(a.end <= b.start for a, b in zip(found, found[1:])) and all(d.start < d.end <= len(text) for d in found)


@pytest.mark.parametrize("text", ["public static " * 3000, "/* " * 4000, "def f(a):\n" * 3000, "x = 1; " * 4000, "a<" * 4000, "(a) => " * 3000, "fn f(a) { " * 1000])
def test_odd_texts_take_time_in_proportion(text):
    began = time.process_time()
    for language in HEADS:
        definitions(language, text)
    assert time.process_time() - began < 20
