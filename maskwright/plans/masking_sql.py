"""The masking operators in DuckDB's SQL: candidates by rule, greedy resolution by recursion, numbering and splicing."""

from __future__ import annotations

from maskwright.config import SECRETS, Engine, Rule
from maskwright.operators import rules as R

LUHN = "list_sum(list_transform(range(1, length(v) + 1), lambda i: case when (length(v) - i) % 2 = 1 then (2 * cast(v[i] as int)) // 10 + (2 * cast(v[i] as int)) % 10 else cast(v[i] as int) end)) % 10 = 0"
SSN = "substring(v, 1, 3) not in ('000', '666') and v[1] <> '9' and substring(v, 5, 2) <> '00' and substring(v, 8, 4) <> '0000'"
IDCARD = "substring('10X98765432', cast(list_sum(list_transform(range(1, 18), lambda i: cast(v[i] as int) * ((2 ** (18 - i))::bigint % 11))) % 11 as int) + 1, 1) = upper(v[18])"
_BARE = "case when length(v) > 1 and v[1] in ('''', '\"') and right(v, 1) = v[1] then substring(v, 2, length(v) - 2) else v end"
_BYTES = f"list_transform(range(strlen({_BARE})), lambda i: substring(hex(encode({_BARE})), 2 * i + 1, 2))"
ENTROPY = f"list_sum(list_transform(list_distinct({_BYTES}), lambda b: -(len(list_filter({_BYTES}, lambda x: x = b)) / len({_BYTES})) * log2(len(list_filter({_BYTES}, lambda x: x = b)) / len({_BYTES})))) >= 3.0 - 1e-12"
PREDICATES = {"bank_card": LUHN, "china_idcard": IDCARD, "us_ssn": SSN, "entropy_password": f"coalesce({ENTROPY}, false)"}
#: Patterns that need another form there, for want of lookaround and back references.
PATTERNS = {
    "email": R.EMAIL_PATTERN,
    "ip": rf"\b{R._SEG}(?:\.{R._SEG}){{3}}\b",
    "private_key": "|".join(rf"-----BEGIN {f}-----[\s\S]*?-----END {f}-----" for f in R._FENCES.split("|")),
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def keyword_rule(words: list[str]) -> Rule:
    """Literals, the longest first."""
    signs = set("\\.+*?()|[]{}^$")
    plain = ["".join("\\" + c if c in signs else c for c in w) for w in sorted(set(words), key=lambda w: (-len(w), w))]
    return Rule("keyword", "KEYWORD", "|".join(plain), 1.0)


def _found(texts: str, rule: Rule, index: int, order: int) -> str:
    """Candidates of a rule in texts (id, text): places in bytes and in code points."""
    p = quoted(PATTERNS.get(rule.name, rule.pattern))
    own = f"regexp_extract_all(text, {p}, {rule.group})" if rule.group else "m"
    edge = "not regexp_matches(right(concat(coalesce(m[i - 1], ''), g[i]), 1), '[0-9]') and not regexp_matches(left(concat(g[i + 1], coalesce(m[i + 1], '')), 1), '[0-9]')" if rule.boundary else "true"
    return f"""
 select id, '{rule.entity}' as ent, b - strlen(v) as s, b as e, c - length(v) as cs, c as ce, cast({rule.score} as double) as score, {index} as idx, {order} * 10000 + i as ord, v from (
  select id, i, g, m, o[i] as v,
   cast(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + list_sum(list_transform(m[1:i], lambda x: strlen(x))) as bigint) as b,
   cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) as bigint) as c
  from (select *, unnest(range(1, len(m) + 1)) as i from (select *, {own} as o from (select id, text, string_split_regex(text, {p}) as g, regexp_extract_all(text, {p}) as m from ({texts})) where len(m) > 0))
 ) where {PREDICATES.get(rule.name, 'true')} and {edge}"""


def findings(texts: str, engine: Engine) -> str:
    """Named parts of a query whose last, `kept`, has the resolved findings (id, ent, s, e, cs, ce, v) of texts (id, text)."""
    plan = [(i, r if r.name != "keyword" else keyword_rule(list(engine.keywords))) for i, r in engine.plan()]
    every = " union all ".join(_found("select id, text from src", r, index, order) for order, (index, r) in enumerate(plan))
    secrets = ", ".join(map(quoted, SECRETS))
    one = "struct_pack(ent := c.ent, s := c.s, e := c.e, cs := c.cs, ce := c.ce, v := c.v)"
    return f"""with recursive src as ({texts}),
cand as materialized ({every}),
c as materialized (select *, row_number() over (partition by id order by case when ent in ({secrets}) then 0 else 1 end, s - e, -score, idx, ord) as k from cand),
taken as (select id, k, [{one}] as acc from c where k = 1
 union all select t.id, c.k, case when len(list_filter(t.acc, lambda a: a.s < c.e and c.s < a.e)) > 0 then t.acc else list_append(t.acc, {one}) end from taken t join c on c.id = t.id and c.k = t.k + 1),
kept as materialized (select id, f.* from (select id, unnest(acc) as f from (select id, arg_max(acc, k) as acc from taken group by id)))"""


def spliced(numbered: str) -> str:
    """Parts `numbered` (id, cs, ce, r) and `masked` (id, masked, n) after those of findings()."""
    return f""",
numbered as ({numbered}),
masked as (select n.id, concat(string_agg(concat(substring(s.text, cast(n.pe + 1 as int), cast(n.cs - n.pe as int)), n.r), '' order by n.cs), substring(any_value(s.text), cast(max(n.ce) + 1 as int))) as masked, count(*) as n
 from (select *, lag(ce, 1, 0) over (partition by id order by cs) as pe from numbered) n join src s on s.id = n.id group by n.id)"""


def mask(texts: str, engine: Engine, columns: str) -> str:
    """mask(): every finding takes the next number of its entity in its own text. columns: of s (src) and m (masked)."""
    number = "select *, concat('[', ent, '_', row_number() over (partition by id, ent order by s), ']') as r from kept"
    return f"{findings(texts, engine)}{spliced(number)} select {columns} from src s left join masked m on m.id = s.id"


def anonymize(texts: str, engine: Engine, columns: str) -> str:
    """anonymize() within the limits: texts (id, session, call, text); reversible plaintexts keep their number."""
    fixed = ", ".join(map(quoted, [e for e in engine.entities if engine.strategy(e) != "placeholder"]))
    number = f"""select *, concat('[', ent, '_', dense_rank() over (partition by session, ent order by first), ']') as r from (
  select *, case when ent in ({fixed}) then place else min(place) over (partition by session, ent, v) end as first from (
   select k.*, s.session, cast(s.call as hugeint) * 100000000 + k.s as place from kept k join src s on s.id = k.id))"""
    return f"{findings(texts, engine)}{spliced(number)} select {columns} from src s left join masked m on m.id = s.id"
