"""TypeScript and PHP extraction on small sources."""

import pytest

from kinweave.extract import php, typescript

TS = {
    "dock/crane.ts": """export interface Lifter { raise(kg: number): void; reach: number; }
export type BerthNo = number;
export enum Tide { Ebb, Flood }
export class Crane {
  hoist(box: string) {
    Ledger.note(box);
    return new Hook();
  }
}
export class Hook {}
let low = 1, high = 2
export const LIMITS: number[] = [low, high];
const { unused } = LIMITS;
export function tonnes(raw: number): number { return raw / 1000; }
""",
    "dock/pilot.ts": """class Radio { call() {} }
class Watch { relieve() {} }
/* class Phantom { } */
class Pilot<T extends Watch> extends Watch implements Rank, harbour.Officer {
  private radio: Radio;
  spare: Radio | undefined;
  sets: Radio[];
  constructor(private readonly second: Radio, idle: Radio) {}
  async board(): Promise<Map<string, Set<Array<number>>>> {
    // this.radio.sink();
    this.radio.call();
    this.second.call(`ship ${Log.line(1)}
      ${this.name({ a: { b: { c: 1 } } })} out`);
    this.idle.call();
    this.spare.call();
    this.salute();
    super.relieve();
    const quote = "this.never()";
  }
  @Duty('night') salute(): void {}
  get rank(): number { return 3 }
  #log() { return /[{]/.test("x") }
  later = () => { this.salute(); }
}
abstract class Vessel extends Watch {
  abstract draught(): number;
  moor(): void { this.draught(); }
}
const berth = async (ship) => {
  Pilot.assign(ship)
  return ship
}
function signal(flag: string): void;
function signal(flag: any): void { Mast.raise(flag) }
""",
    "dock/odd.ts": """class R {
  a() {
    match(
                            /[{]/, text);
    if (text) /[}]/.test(text)
    return  /[{]{3}/g
  }
  b() { half(a / 2, b / 2) }
}
class R2 {
  c() { Q.go(x => /[{]/.exec(x)) }
}
""",
    "dock/view.tsx": """class A {
  render() { return <ul>{items.map(x => <li key={x}>{x}</li>)}</ul>; }
  after() { return <div>{a}</div>; }
}
class B {
  one() { return <p>{t}</p> }
  two() {}
}
""",
    "dock/broken.ts": "class Open { m() { if (x) { }\n",
}
PHP = {
    "port/Quay.php": """<header><?php
namespace Port\\Works;
use Sea\\Gauge;
#[Entity(name: 'q', keys: [new Key(columns: ['a', ['b' => [1, [2]]]])])]
final class Quay extends \\Port\\Structure implements Charted
{
    use Numbered, Lit;
    private Winch $north, $south;
    private Winch|Buoy $either;
    public function __construct(private ?Gauge $tide, int $depth) {}
    #[Route('/a]b[c')]
    public function close(): void {
        $this->north->wind();
        $this->tide->read(); // $this->nobody();
        $this->south->wind();
        $this->either->drop();
        $this->unknown->act();
        $this->lower("$this->z()");
        self::lock(); parent::shut(); static::rest();
        Tariff::charge();
        $one = new \\Port\\Crew\\Mate();
        $two = new class { public function within() {} };
        $text = <<<NOTE
        class Written { }
        NOTE;
    }
    abstract public function lower(): void;
}
interface Payer { public function pay(int $dues): bool; }
trait Lit { public function shine() {} }
enum Flag: string { case Red = 'r'; public function mean() {} }
function fathoms(float $metres): float { return $metres / 1.83; }
?>
<p>class Markup {}</p>
""",
    "port/two.php": """<?php
namespace Port\\North {
    class Pier {
        public function length(): float { return 0.0; }
    }
}
namespace Port\\South {
    class Jetty { public function m() {} }
}
""",
}


def run(spark, module, sources):
    files = spark.createDataFrame(list(sources.items()), "file_path string, text string")
    return module.extract(files)


@pytest.fixture(scope="module")
def ts(spark):
    return run(spark, typescript, TS)


@pytest.fixture(scope="module")
def ph(spark):
    return run(spark, php, PHP)


def symbols(extraction, path):
    rows = extraction.symbols.filter(f"file_path = '{path}'").collect()
    return {(r.fqn, r.symbol_type, r.line_start, r.line_end) for r in rows}


def refs(extraction, path):
    rows = extraction.refs.filter(f"file_path = '{path}'").collect()
    return sorted((r.caller_id.split("::")[1], r.target_name, r.kind, r.line) for r in rows)


def test_ts_declarations(ts):
    assert symbols(ts, "dock/crane.ts") == {
        ("Lifter", "interface", 1, 1),
        ("Lifter.raise", "method", 1, 1),
        ("BerthNo", "type", 2, 2),
        ("Tide", "enum", 3, 3),
        ("Crane", "class", 4, 9),
        ("Crane.hoist", "method", 5, 8),
        ("Hook", "class", 10, 10),
        ("low", "constant", 11, 11),
        ("high", "constant", 11, 11),
        ("LIMITS", "constant", 12, 12),
        ("tonnes", "function", 14, 14),
    }


def test_ts_members(ts):
    assert symbols(ts, "dock/pilot.ts") == {
        ("Radio", "class", 1, 1),
        ("Radio.call", "method", 1, 1),
        ("Watch", "class", 2, 2),
        ("Watch.relieve", "method", 2, 2),
        ("Pilot", "class", 4, 24),
        ("Pilot.constructor", "method", 8, 8),
        ("Pilot.board", "method", 9, 19),
        ("Pilot.salute", "method", 20, 20),
        ("Pilot.rank", "method", 21, 21),
        ("Pilot.#log", "method", 22, 22),
        ("Vessel", "class", 25, 28),
        ("Vessel.moor", "method", 27, 27),
        ("berth", "constant", 29, 32),
        ("signal", "function", 34, 34),
    }


def test_ts_calls(ts):
    assert refs(ts, "dock/crane.ts") == [
        ("Crane.hoist", "Hook", "instantiation", 7),
        ("Crane.hoist", "Ledger.note", "static_call", 6),
    ]
    found = refs(ts, "dock/pilot.ts")
    # a call in an arrow-function field belongs to the class, which has no outer class
    assert set(found) >= {
        ("Pilot.board", "Radio.call", "static_call", 11),
        ("Pilot.board", "Radio.call", "static_call", 12),
        ("Pilot.board", "Log.line", "static_call", 12),
        ("Pilot.board", "Pilot.salute", "static_call", 16),
        ("Pilot.board", "parent::relieve", "static_call", 17),
        ("Vessel.moor", "Vessel.draught", "static_call", 27),
        ("berth", "Pilot.assign", "static_call", 30),
        ("signal", "Mast.raise", "static_call", 34),
    }
    assert not any(name in target for _, target, *_ in found for name in ("sink", "never", "Phantom"))


def test_ts_calls_in_templates(spark, ts):
    assert ("Pilot.board", "Pilot.name", "static_call", 13) in refs(ts, "dock/pilot.ts")
    deep = "x"
    for i in range(14):
        deep = f"`${{D.f{i}({deep})}}`"
    sources = {
        "dock/text.ts": """class T {
  a() {
    const one = `x ${this.name({a: 1})} ${xs.map(x => { return F.f(x) })}
      ${G.g(`a ${H.h({ b: `${new K()}` })}
      ` + `c`)} \\${no.no()}`;
    return `${s.replace(/a/g, B.b({}))}`
  }
  c() { U.u() }
}
""",
        "dock/deep.ts": "class D { m() { return " + "`${" + "{" * 20 + "M.m()" + "}" * 20 + "}` } }\n",
        "dock/inner.ts": "class D { m() { return " + deep + " } }\n",
    }
    got = run(spark, typescript, sources)
    assert refs(got, "dock/text.ts") == sorted(
        [
            ("T.a", "T.name", "static_call", 3), ("T.a", "F.f", "static_call", 3), ("T.a", "G.g", "static_call", 4), ("T.a", "xs.map", "static_call", 3),
            ("T.a", "H.h", "static_call", 4), ("T.a", "K", "instantiation", 4), ("T.a", "s.replace", "static_call", 6), ("T.a", "B.b", "static_call", 6),
            ("T.c", "U.u", "static_call", 8),
        ]
    )
    assert got.errors.count() == 0
    assert refs(got, "dock/deep.ts") == [("D", "M.m", "static_call", 1)]  # of symbols on one line the first
    assert refs(got, "dock/inner.ts") == sorted(("D", f"D.f{i}", "static_call", 1) for i in range(14))


TSX = """class A<T extends object> {
  render() {
    return (
      <Panel<Row> title="it's {open" on={() => this.save({ a: 1 })} side=<Icon name='}' />>
        Don't stop {this.x ? 'a' : 'b'} here: it's 5 > 4 && "quoted
        {/* { a comment's brace */}
        <>
          {rows.map(r => <li key={r.id}>{Fmt.line(r)} isn't `that`</li>)}
          <Deep.Inner.Part {...Props.of(r)} /><br/>
        </>
      </Panel>
    );
  }
  after() { const n = a < b ? <T,>(x: T) => Id.of(x) : c > d; return cond && <p>won't {`t ${Log.say(<b>it's</b>)}`}</p> }
  same() { if (a < b && c > d) { Cmp.run() } }
}
class B {
  m() { return new A<Map<string, Array<number>>>(); }
}
"""


def test_tsx_text_is_no_code(spark):
    got = run(spark, typescript, {"ui/view.tsx": TSX, "ui/probe.tsx": (
        "class A {\n  m() { return <p>Don't stop {this.x ? 'a' : 'b'}</p> }\n  after() {}\n}\nclass B {\n  m() { Z.go() }\n}\n"
    )})
    assert got.errors.count() == 0
    assert symbols(got, "ui/probe.tsx") == {
        ("A", "class", 1, 4), ("A.m", "method", 2, 2), ("A.after", "method", 3, 3), ("B", "class", 5, 7), ("B.m", "method", 6, 6),
    }
    assert refs(got, "ui/probe.tsx") == [("B.m", "Z.go", "static_call", 6)]
    assert symbols(got, "ui/view.tsx") == {
        ("A", "class", 1, 16), ("A.render", "method", 2, 13), ("A.after", "method", 14, 14), ("A.same", "method", 15, 15),
        ("B", "class", 17, 19), ("B.m", "method", 18, 18),
    }
    assert refs(got, "ui/view.tsx") == sorted([
        ("A.render", "A.save", "static_call", 4), ("A.render", "rows.map", "static_call", 8), ("A.render", "Fmt.line", "static_call", 8),
        ("A.render", "Props.of", "static_call", 9), ("A.after", "Id.of", "static_call", 14), ("A.after", "Log.say", "static_call", 14),
        ("A.same", "Cmp.run", "static_call", 15), ("B.m", "A", "instantiation", 18),
    ])


def test_nesting_has_no_limit(spark):
    deep = 50
    template = "x"
    for i in range(deep):
        template = f"`a ${{F.f{i}({template})}} b`"
    types = "Array<" * deep + "string" + ">" * deep
    tags = "".join(f"<d{i} a={{G.g{i}()}}>it's " for i in range(deep)) + "".join(f"</d{i}>" for i in reversed(range(deep)))
    braces = "{" * deep + "H.h()" + "}" * deep
    got = run(spark, typescript, {
        "deep/a.tsx": f"class D {{\n  t() {{ return {template} }}\n  g() {{ new Box<{types}>(); K.make<{types}>(1) }}\n  x() {{ return {tags} }}\n  b() {braces}\n}}\nclass E {{}}\n",
    })
    assert got.errors.count() == 0
    assert {s[0] for s in symbols(got, "deep/a.tsx")} == {"D", "D.t", "D.g", "D.x", "D.b", "E"}
    assert refs(got, "deep/a.tsx") == sorted(
        [("D.t", f"F.f{i}", "static_call", 2) for i in range(deep)] + [("D.g", "Box", "instantiation", 3), ("D.g", "K.make", "static_call", 3)]
        + [("D.x", f"G.g{i}", "static_call", 4) for i in range(deep)] + [("D.b", "H.h", "static_call", 5)]
    )
    attribute = "#[A(" + "[" * deep + "'x]'" + "]" * deep + ")]"
    got = run(spark, php, {"deep/a.php": f"<?php\n{attribute}\nclass P {{\n  {attribute}\n  public function m() {{ Q::go(); }}\n}}\nclass R {{}}\n"})
    assert got.errors.count() == 0
    assert symbols(got, "deep/a.php") == {("P", "class", 2, 6), ("P.m", "method", 4, 5), ("R", "class", 7, 7)}
    assert refs(got, "deep/a.php") == [("P.m", "Q.go", "static_call", 5)]


def test_what_does_not_close_is_an_error_and_long_lines_are_read_once(spark):
    got = run(spark, typescript, {
        "bad/a.ts": "class A { m() { return `open ${x} } }\n", "bad/b.tsx": "class B { m() { return <p>{x}; } }\n",
        "long/c.ts": "class C { m() { return " + "a<" * 50_000 + "b; }\n n() { L.l() }\n}\n",
    })
    errors = {r.file_path: r.error for r in got.errors.collect()}
    assert set(errors) == {"bad/a.ts", "bad/b.tsx"}
    assert refs(got, "long/c.ts") == [("C.n", "L.l", "static_call", 2)]


def test_ts_literals_and_tags_keep_the_structure(ts):
    assert symbols(ts, "dock/odd.ts") == {
        ("R", "class", 1, 9), ("R.a", "method", 2, 7), ("R.b", "method", 8, 8), ("R2", "class", 10, 12), ("R2.c", "method", 11, 11),
    }
    assert refs(ts, "dock/odd.ts") == [("R2.c", "Q.go", "static_call", 11)]
    assert {s[0] for s in symbols(ts, "dock/view.tsx")} == {"A", "A.render", "A.after", "B", "B.one", "B.two"}


def test_files_that_do_not_balance_are_reported(ts, ph):
    assert [(r.file_path, r.error) for r in ts.errors.collect()] == [("dock/broken.ts", "braces are not balanced")]
    assert ph.errors.count() == 0


def test_ts_inheritance(ts):
    pairs = {(r.child, r.parent) for r in ts.inheritance.filter("file_path = 'dock/pilot.ts'").collect()}
    assert pairs == {("Pilot", "Watch"), ("Pilot", "Rank"), ("Pilot", "Officer")}


def test_php_declarations(ph):
    assert symbols(ph, "port/Quay.php") == {
        ("Quay", "class", 4, 28),
        ("Quay.__construct", "method", 10, 10),
        ("Quay.close", "method", 11, 26),
        ("Quay.lower", "method", 27, 27),
        ("Payer", "interface", 29, 29),
        ("Payer.pay", "method", 29, 29),
        ("Lit", "class", 30, 30),
        ("Lit.shine", "method", 30, 30),
        ("Flag", "enum", 31, 31),
        ("fathoms", "function", 32, 32),
    }
    assert symbols(ph, "port/two.php") == {
        ("Pier", "class", 3, 5),
        ("Pier.length", "method", 4, 4),
        ("Jetty", "class", 8, 8),
        ("Jetty.m", "method", 8, 8),
    }


def test_php_calls(ph):
    who = "Quay.close"
    assert refs(ph, "port/Quay.php") == sorted(
        [
            (who, "Winch.wind", "static_call", 13),
            (who, "Gauge.read", "static_call", 14),
            (who, "Winch.wind", "static_call", 15),
            (who, "Quay.lower", "static_call", 18),
            (who, "Quay.lock", "static_call", 19),
            (who, "parent::shut", "static_call", 19),
            (who, "Tariff.charge", "static_call", 20),
            (who, "Mate", "instantiation", 21),
        ]
    )


def test_php_inheritance(ph):
    pairs = {(r.child, r.parent) for r in ph.inheritance.collect()}
    assert pairs == {("Quay", "Structure"), ("Quay", "Numbered"), ("Quay", "Lit")}
