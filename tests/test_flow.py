"""Edges over branches and loops against a plain interpreter of random programs."""

import random

import duckdb

from nameshift.operators import dataflow, flow
from nameshift.oracles import ORACLES
from nameshift.plans.queries import QUERIES


class Program:
    """A random program as tokens, and the edges that walking its tree gives."""

    def __init__(self, seed):
        self.r, self.tokens, self.edges = random.Random(seed), [], {}
        tree = [self.statement(0) for _ in range(self.r.randint(2, 7))]
        self.write(tree)
        self.walk(tree, {})

    def statement(self, depth):
        kind = self.r.choice(("set", "set", "set", "if", "while", "do")) if depth < 3 else "set"
        body = lambda: [self.statement(depth + 1) for _ in range(self.r.randint(1, 3))]
        if kind == "set":
            return ["set", self.r.choice("uvw"), self.r.choice("uvw")]
        if kind == "if":
            arms = [[self.r.choice("uvw"), body()] for _ in range(self.r.randint(1, 3))]
            return ["if", arms, body() if self.r.random() < 0.5 else None]
        return [kind, self.r.choice("uvw"), body()]

    def put(self, *tokens):
        self.tokens += tokens
        return len(self.tokens) - 1

    def block(self, body):
        if len(body) == 1 and body[0][0] == "set" and self.r.random() < 0.5:
            return self.write(body)
        self.put("{")
        self.write(body)
        self.put("}")

    def write(self, tree):
        for s in tree:
            if s[0] == "set":
                a = self.put(s[1])
                s += [a, self.put("=", s[2])]
                self.put(";")
            elif s[0] == "if":
                for k, arm in enumerate(s[1]):
                    if k:
                        self.put("else")
                    arm.append(self.put("if", "(", arm[0]))
                    self.put(")")
                    self.block(arm[1])
                if s[2]:
                    self.put("else")
                    self.block(s[2])
            elif s[0] == "while":
                s.append(self.put("while", "(", s[1]))
                self.put(")")
                self.block(s[2])
            else:
                self.put("do")
                self.block(s[2])
                s.append(self.put("while", "(", s[1]))
                self.put(")", ";")

    def see(self, name, pos, state, is_def=False):
        if state.get(name):
            self.edges.setdefault((name, pos), set()).update(state[name])
        elif is_def:
            self.edges.setdefault((name, pos), set())

    def walk(self, tree, state):
        for s in tree:
            if s[0] == "set":
                self.see(s[1], s[3], state, True)
                # the value is read after the name, by the order of the tokens
                self.see(s[2], s[4], {**state, s[1]: {s[3]}})
                state = {**state, s[1]: {s[3]}}
            elif s[0] == "if":
                ends = [state]
                for name, body, pos in s[1]:
                    self.see(name, pos, state)
                    ends.append(self.walk(body, state))
                if s[2]:
                    ends.append(self.walk(s[2], state))
                state = {n: set().union(*[e.get(n, set()) for e in ends]) for n in "uvw"}
            else:
                for _ in range(2):
                    if s[0] == "while":
                        self.see(s[1], s[3], state)
                    state = self.walk(s[2], state)
                if s[0] == "do":
                    self.see(s[1], s[3], state)
        return state


def comes_from(frame):
    return {(r.sample_id, r.name, r.pos): set(r.src_pos) for r in frame.where("rel = 'comesFrom'").collect()}


def test_random_programs_equal_the_interpreter(spark):
    programs = [Program(k) for k in range(150)]
    samples = spark.createDataFrame([(k, " ".join(p.tokens)) for k, p in enumerate(programs)], "sample_id long, code string")
    got = comes_from(flow.flow_edges(samples, "c"))
    want = {(k, name, pos): src for k, p in enumerate(programs) for (name, pos), src in p.edges.items()}
    assert got == want


def test_straight_code_has_the_straight_edges(spark):
    samples = spark.createDataFrame([(1, "a = b ; b = a + c ; a = a ;"), (2, ""), (3, None), (4, "} ) a = a ; { ("), (5, "if ( a"), (6, "else else while if do")], "sample_id long, code string")
    straight = dataflow.merge_edges(dataflow.def_use_edges(dataflow.statement_rows(samples, "c")))
    rows = lambda f: sorted((r.sample_id, r.name, r.pos, r.rel, tuple(r.src_names), tuple(r.src_pos)) for r in f.collect())
    assert rows(flow.flow_edges(samples, "c")) == rows(straight)
    assert flow.flow_edges(samples.limit(0), "c").count() == 0


def test_edges_are_joined_by_keys(spark):
    samples = spark.createDataFrame([(1, "a = b ;")], "sample_id long, code string")
    plan = flow.flow_edges(samples, "c")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "NestedLoop", "Python", "Arrow"))


def test_the_sql_agrees_on_random_programs(spark, tmp_path):
    rows = [(k, " ".join(Program(k).tokens)) for k in range(40)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = "sample_id, name, pos, rel, src_names, src_pos"
    want = con.sql(f"SELECT {columns} FROM ({ORACLES['flow_edges']})").fetchall()
    assert any(" " in row[-1] for row in want)
    assert sorted(map(tuple, QUERIES["flow_edges"](spark, str(tmp_path)).selectExpr(*columns.split(", ")).collect())) == sorted(want)
