"""DuckDB text for the bar queries: an independent statement of what they compute."""

from __future__ import annotations

BARS = """
bars AS (
  SELECT code, day, arg_min(px, ord) AS o, max(px) AS h, min(px) AS l, arg_max(px, ord) AS c, sum(q) AS v, sum(a::DECIMAL(18,2))::DOUBLE AS va
  FROM (SELECT l_suppkey AS code, l_shipdate::DATE AS day, l_extendedprice / l_quantity AS px, l_quantity AS q, l_extendedprice AS a,
          (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS ord FROM lineitem)
  GROUP BY code, day)"""


def over(a: str, lo: int | str, hi: int | str, key: str = "code", order: str = "day") -> str:
    bound = lambda n: "UNBOUNDED PRECEDING" if n == "all" else "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"
    return f"{a} OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {bound(lo)} AND {bound(hi)})"


def roll(x: str, n: int, agg: str = "avg") -> str:
    return f"CASE WHEN {over(f'count({x})', 1 - n, 0)} >= {n} THEN {over(f'{agg}({x})', 1 - n, 0)} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY code ORDER BY day)"


def gap(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN (({a}) / ({b}) - 1) * 100 END"


def div(a: str, b: str, fill: str = "NULL") -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) WHEN ({b}) = 0 THEN {fill} END"


ROW = "row_number() OVER (PARTITION BY code ORDER BY day)"


def steps(*layers: dict[str, str], out: dict[str, str], digits: int = 4) -> str:
    """bars, then layers of named expressions, then the columns of out, rounded."""
    parts, last = [BARS], "bars"
    for i, layer in enumerate(layers):
        parts.append(f"s{i} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in layer.items()) + f" FROM {last})")
        last = f"s{i}"
    parts.append("z AS (SELECT code, day, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in out.items()) + f" FROM {last})")
    return "WITH " + ",".join(parts) + " SELECT code, day, " + ", ".join(f"round({n} + 3e-7, {digits}) AS {n}" for n in out) + " FROM z"




def moving_averages() -> str:
    n = (5, 10, 25, 50, 75, 100, 200)
    out = {f"tx_ma_gap_{k}": gap("c", f"sma{k}") for k in n} | {f"tx_ma_slope_{k}": gap(f"sma{k}", lag(f"sma{k}", 5)) for k in (25, 75, 200)} | {f"tx_ma_ratio_{a}_{b}": gap(f"sma{a}", f"sma{b}") for a, b in ((5, 25), (25, 75), (50, 200))}
    out["tx_perfect_order"] = "CASE WHEN sma200 IS NOT NULL THEN (sma5 > sma25)::INT + (sma25 > sma75)::INT + (sma75 > sma200)::INT END"
    out["tx_ma_cross_days"] = over("count(*)", "all", 0, "code, rn") + " * sg"
    return steps({f"sma{k}": roll("c", k) for k in n}, {"sg": "sign(sma25 - sma75)"}, {"nw": f"CASE WHEN sg IS NOT DISTINCT FROM {lag('sg')} THEN 0 ELSE 1 END"}, {"rn": over("sum(nw)", "all", 0)}, out=out)


def channels() -> str:
    hl = {f"h{n}": roll("h", n, "max") for n in (9, 14, 20, 26, 52, 55)} | {f"l{n}": roll("l", n, "min") for n in (9, 14, 20, 26, 52, 55)}
    out = {
        "tx_bb_pctb": "100 * (" + div("c - (m20 - 2 * sd20)", "4 * sd20", "0.5") + ")",
        "tx_bb_width": "100 * (" + div("4 * sd20", "m20") + ")",
        "tx_donchian_pos_20": "100 * (" + div("c - l20", "h20 - l20", "0.5") + ")",
        "tx_donchian_pos_55": "100 * (" + div("c - l55", "h55 - l55", "0.5") + ")",
        "tx_stoch_k": "slow",
        "tx_stoch_d": roll("slow", 3),
        "tx_williams_r_14": "-100 * (" + div("h14 - c", "h14 - l14", "0.5") + ")",
        "tx_aroon_up_25": f"CASE WHEN i >= 26 THEN 100 * (25 - (i - {over('arg_max(i, (h, i))', -25, 0)})) / 25.0 END",
        "tx_aroon_down_25": f"CASE WHEN i >= 26 THEN 100 * (25 - (i - {over('arg_max(i, (-l, i))', -25, 0)})) / 25.0 END",
        "tx_cci_20": "CASE WHEN i >= 20 THEN " + div("tp - tp20", f"0.015 * list_sum(list_transform({over('list(tp)', -19, 0)}, lambda x: abs(x - tp20))) / 20", "0") + " END",
        "tx_ichi_tk": "(ten - kij) / c * 100",
        "tx_ichi_kijun_gap": gap("c", "kij"),
        "tx_ichi_cloud_pos": "CASE WHEN sa IS NOT NULL AND sb IS NOT NULL THEN (CASE WHEN c > greatest(sa, sb) THEN (c - greatest(sa, sb)) / c WHEN c < least(sa, sb) THEN (c - least(sa, sb)) / c ELSE 0 END) * 100 END",
        "tx_ichi_cloud_thick": "(sa - sb) / c * 100",
        "tx_ichi_chikou": gap("c", "c25"),
        "tx_ichi_sanyaku": "CASE WHEN ten + kij + sa + sb + c25 IS NOT NULL THEN (ten > kij)::INT + (c > greatest(sa, sb))::INT + (c > c25)::INT END",
    }
    return steps(hl | {"tp": "(h + l + c) / 3", "i": ROW, "m20": roll("c", 20), "sd20": roll("c", 20, "stddev_pop")}, {"fast": "100 * (" + div("c - l14", "h14 - l14", "0.5") + ")", "tp20": roll("tp", 20), "ten": "(h9 + l9) / 2", "kij": "(h26 + l26) / 2", "sb0": "(h52 + l52) / 2"}, {"slow": roll("fast", 3), "sa": lag("(ten + kij) / 2", 25), "sb": lag("sb0", 25), "c25": lag("c", 25)}, out=out)


def momentum() -> str:
    s = lambda x, n: roll(x, n, "sum")
    # the window's time runs from 0, so that its mean is (k - 1) / 2
    cov = lambda k: f"CASE WHEN i >= {k} THEN list_sum(list_transform({over('list(ln(c))', 1 - k, 0)}, lambda y, j: y * (j - 1 - {(k - 1) / 2}))) / {k} END"
    out = {f"tx_roc_{k}": gap("c", lag("c", k)) for k in (10, 60, 120, 250)} | {
        "tx_kaufman_er_20": div(f"abs(c - {lag('c', 20)})", s("abs(d)", 20), "0"),
        "tx_cmo_14": "100 * (" + div("su - sd", "su + sd", "0") + ")",
        "tx_dpo_20": f"({lag('c', 11)} - {roll('c', 20)}) / c * 100".replace("- CASE", "- (CASE").replace("END)", "END))"),
        "tx_kst": " + ".join(f"{w} * ({roll(f'roc{k}', n)})" for w, k, n in ((1, 10, 10), (2, 15, 10), (3, 20, 10), (4, 30, 15))),
        "tx_awesome_osc": f"(({roll('mp', 5)}) - ({roll('mp', 34)})) / c * 100",
        "tx_psy_12": f"CASE WHEN i > 12 THEN 100 * ({s('(d > 0)::INT', 12)}) / 12 END",
        "tx_vortex_pos_14": div(s("abs(h - pl)", 14), "st"),
        "tx_vortex_neg_14": div(s("abs(l - ph)", 14), "st"),
        "tx_linreg_slope_20": f"({cov(20)}) / (399 / 12.0) * 100",
        "tx_linreg_slope_60": f"({cov(60)}) / (3599 / 12.0) * 100",
        "tx_linreg_r2_60": div(f"pow({cov(60)}, 2)", f"3599 / 12.0 * ({roll('ln(c)', 60, 'var_pop')})", "0"),
        "tx_chop_14": "CASE WHEN i > 14 THEN 100 * log10(" + div("st", f"({roll('h', 14, 'max')}) - ({roll('l', 14, 'min')})") + ") / log10(14) END",
    }
    first = {"i": ROW, "pc": lag("c"), "ph": lag("h"), "pl": lag("l"), "mp": "(h + l) / 2"} | {f"roc{k}": gap("c", lag("c", k)) for k in (10, 15, 20, 30)}
    second = {"d": "c - pc", "tr": "CASE WHEN pc IS NULL THEN h - l ELSE greatest(h - l, abs(h - pc), abs(l - pc)) END", "up": "CASE WHEN pc IS NULL THEN 0 ELSE greatest(c - pc, 0) END", "dn": "CASE WHEN pc IS NULL THEN 0 ELSE greatest(pc - c, 0) END"}
    return steps(first, second, {"su": s("up", 14), "sd": s("dn", 14), "st": s("tr", 14)}, out=out)


def volatility() -> str:
    sd = {n: f"({roll('r', n, 'stddev_samp')})" for n in (5, 20, 60, 120)}
    out = {"vol_5": sd[5], "vol_20": sd[20], "tx_vol_60": sd[60], "vol_ratio_5_20": div(sd[5], sd[20]), "vol_ratio_20_120": div(sd[20], sd[120]), "semi_20": f"sqrt({roll('dn', 20)})", "tx_vol_parkinson_20": f"sqrt(({roll('hl', 20)}) / (4 * ln(2))) * 100", "tx_ulcer_14": f"sqrt({roll('dd', 14)})"}
    return steps({"r": gap("c", lag("c")), "hl": "pow(ln(h / l), 2)", "m14": roll("c", 14, "max")}, {"dd": f"pow({gap('c', 'm14')}, 2)", "dn": "CASE WHEN r IS NULL THEN 0 ELSE pow(least(r, 0), 2) END"}, out=out)


def volume() -> str:
    s = lambda x, n: roll(x, n, "sum")
    mf = f"({s('pos', 14)})"
    up, dn = (s(f"CASE WHEN {c} THEN v WHEN d = 0 THEN v / 2 ELSE 0 END", 25) for c in ("d > 0", "d < 0"))
    out = {
        "tx_obv_chg_20": "CASE WHEN i > 20 THEN 100 * (" + div(s("sv", 20), "v20") + ") END",
        "tx_obv_ma_gap": "100 * (" + div(f"obv - ({roll('obv', 20)})", "v20") + ")",
        "tx_ad_ma_gap": "100 * (" + div(f"ad - ({roll('ad', 20)})", "v20") + ")",
        "tx_cmf_20": div(s("mfv", 20), "v20"),
        "tx_mfi_14": f"CASE WHEN i > 14 THEN 100 * (" + div(mf, f"{mf} + ({s('neg', 14)})", "0.5") + ") END",
        "tx_vwap_gap_20": gap("c", "(" + s("tp * v", 20) + ") / v20"),
        "tx_vwap_gap_60": gap("c", "(" + s("tp * v", 60) + ") / (" + s("v", 60) + ")"),
        "tx_pvt_chg_20": "CASE WHEN i > 20 THEN " + div(s("coalesce(d / (c - d), 0) * 100 * v", 20), "v20") + " END",
        "tx_vr_25": "CASE WHEN i > 25 THEN least(100 * (" + div(up, dn, "10") + "), 1000) END",
        "tx_vol_osc_5_20": gap(roll("v", 5), roll("v", 20)),
        "tx_vol_ratio_60_250": div(roll("v", 60), roll("v", 250)),
        "tx_up_vol_share_20": "CASE WHEN i > 20 THEN 100 * (" + div(s("CASE WHEN d > 0 THEN v ELSE 0 END", 20), "v20") + ") END",
        "tx_tv_ratio_20_120": div(roll("va", 20), roll("va", 120)),
    }
    first = {"i": ROW, "d": f"c - {lag('c')}", "tp": "(h + l + c) / 3", "mfv": "(" + div("(c - l) - (h - c)", "h - l", "0") + ") * v", "v20": s("v", 20)}
    second = {"sv": "coalesce(sign(d), 0) * v", "pos": f"CASE WHEN tp > {lag('tp')} THEN tp * v ELSE 0 END", "neg": f"CASE WHEN tp < {lag('tp')} THEN tp * v ELSE 0 END"}
    return steps(first, second, {"obv": over("sum(sv)", "all", 0), "ad": over("sum(mfv)", "all", 0)}, out=out)


def candles() -> str:
    out = {
        "tx_body_ratio": div("c - o", "h - l", "0"),
        "tx_upper_shadow": div("h - greatest(o, c)", "h - l", "0"),
        "tx_lower_shadow": div("least(o, c) - l", "h - l", "0"),
        "tx_bull_share_20": f"100 * ({roll('(c > o)::INT', 20)})",
        "tx_body_mean_20": roll("(" + div("abs(c - o)", "h - l", "0") + ")", 20),
        "tx_bop_14": roll("(" + div("c - o", "h - l", "0") + ")", 14),
        "tx_gap_up_count_20": f"CASE WHEN i > 20 THEN {roll('(l > ph)::INT', 20, 'sum')} END",
        "tx_engulfing": "CASE WHEN i > 1 THEN (c > o AND pc < po AND c > po AND o < pc)::INT - (c < o AND pc > po AND c < po AND o > pc)::INT END",
        "tx_nr7": f"CASE WHEN i > 6 THEN (h - l <= {over('min(h - l)', -6, 0)})::INT END",
        "tx_three_soldiers": f"CASE WHEN i > 3 THEN (st AND {lag('st')} AND {lag('st', 2)})::INT END",
        "tx_candle_streak": over("count(*)", "all", 0, "code, r1") + " * s1",
        "tx_close_streak": over("count(*)", "all", 0, "code, r2") + " * s2",
    }
    first = {"i": ROW, "po": lag("o"), "pc": lag("c"), "ph": lag("h")}
    second = {"st": f"c > o AND c > pc AND h > ph AND l > {lag('l')}", "s1": "sign(c - o)", "s2": "sign(c - pc)"}
    third = {"n1": f"CASE WHEN s1 IS NOT DISTINCT FROM {lag('s1')} THEN 0 ELSE 1 END", "n2": f"CASE WHEN s2 IS NOT DISTINCT FROM {lag('s2')} THEN 0 ELSE 1 END"}
    return steps(first, second, third, {"r1": over("sum(n1)", "all", 0), "r2": over("sum(n2)", "all", 0)}, out=out)


def ema(x: str, alpha: str, before: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN r.{before} WHEN r.{before} IS NULL THEN {x} ELSE {alpha} * ({x}) + (1 - {alpha}) * r.{before} END"


def head(x: str, n: int) -> str:
    return f"CASE WHEN i > {n} THEN {x} END"


def recursive(layers: list[dict[str, str]], states: dict[str, tuple[str, str]], more: list[dict[str, str]], out: dict[str, str]) -> str:
    """bars with layers of windows (t), states that go from row to row of a code (first value and next value), windows over these, and the columns."""
    parts, last = [BARS], "bars"
    for n, layer in enumerate(layers):
        parts.append(f"t{n} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in layer.items()) + f" FROM {last})")
        last = f"t{n}"
    start = ", ".join(f"({e})::DOUBLE AS {c}" for c, (e, _) in states.items())
    following = ", ".join(f"({e})::DOUBLE AS n_{c}" for c, (_, e) in states.items())
    parts.append(f"r AS (SELECT code, i, {start} FROM {last} t WHERE i = 1 UNION ALL SELECT code, i, {', '.join('n_' + c for c in states)} FROM (SELECT t.code, t.i, {following} FROM r JOIN {last} t ON t.code = r.code AND t.i = r.i + 1))")
    parts.append(f"u AS (SELECT t.*, r.* EXCLUDE (code, i) FROM {last} t JOIN r USING (code, i))")
    last = "u"
    for n, layer in enumerate(more):
        parts.append(f"u{n} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in layer.items()) + f" FROM {last})")
        last = f"u{n}"
    parts.append("z AS (SELECT code, day, " + ", ".join(f"({e})::DOUBLE AS {c}" for c, e in out.items()) + f" FROM {last})")
    return "WITH RECURSIVE " + ",".join(parts) + " SELECT code, day, " + ", ".join(f"round({c} + 3e-7, 4) AS {c}" for c in out) + " FROM z"


BASE = {"i": ROW, "pc": lag("c"), "ph": lag("h"), "pl": lag("l"), "pv": lag("v"), "rng": "h - l", "mp": "(h + l) / 2"}
TRUE_RANGE = "CASE WHEN pc IS NULL THEN h - l ELSE greatest(h - l, abs(h - pc), abs(l - pc)) END"


def _ema_state(x: str, alpha: str, name: str, first: str | None = None) -> tuple[str, str]:
    return (x if first is None else first, ema(x, alpha, name))


def averages() -> str:
    span = lambda x, n, name, first=None: _ema_state(x, f"(2.0 / {n + 1})", name, first)
    kv = "CASE WHEN i > 1 THEN CASE WHEN h + l + c > ph + pl + pc THEN v ELSE -v END END"
    states = {
        "e12": span("c", 12, "e12"), "e26": span("c", 26, "e26"), "sig": span("n_e12 - n_e26", 9, "sig", "0"), "a1": span("c", 15, "a1"), "a2": span("n_a1", 15, "a2", "c"), "a3": span("n_a2", 15, "a3", "c"), "e13": span("c", 13, "e13"),
        "m1": span("d", 25, "m1"), "m2": span("n_m1", 13, "m2", "NULL"), "b1": span("abs(d)", 25, "b1"), "b2": span("n_b1", 13, "b2", "NULL"), "f13": span("d * v", 13, "f13"), "k34": span("kv", 34, "k34"), "k55": span("kv", 55, "k55"),
    }
    out = {
        "tx_macd": head("(e12 - e26) / c * 100", 25), "tx_macd_signal": head("sig / c * 100", 34), "tx_macd_hist": head("(e12 - e26 - sig) / c * 100", 34), "tx_trix_15": head(gap("a3", lag("a3")), 44), "tx_tsi": head("100 * (" + div("m2", "b2", "0") + ")", 38),
        "tx_elder_bull": head("(h - e13) / c * 100", 12), "tx_elder_bear": head("(l - e13) / c * 100", 12), "tx_force_13": head("100 * (" + div("f13", f"c * ({roll('v', 20)})") + ")", 19), "tx_klinger": head(div("k34 - k55", roll("v", 20)), 55),
    }
    return recursive([BASE, {"d": "c - pc", "kv": kv}], states, [], out)


def trends() -> str:
    wilder = lambda x, n, name, first=None: _ema_state(x, f"(1.0 / {n})", name, first)
    moves = {"up": "h - ph", "dn": "pl - l", "tr": TRUE_RANGE, "pph": lag("h", 2), "ppl": lag("l", 2)}
    direction = {"plus": "CASE WHEN up IS NOT NULL THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END END", "minus": "CASE WHEN up IS NOT NULL THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END END"}
    # the level follows the extreme, is held off the last two bars, and jumps to the extreme when the bar crosses it
    held = "CASE WHEN r.pu = 1 THEN least(r.sar + r.af * (r.ep - r.sar), pl, coalesce(ppl, pl)) ELSE greatest(r.sar + r.af * (r.ep - r.sar), ph, coalesce(pph, ph)) END"
    turned = "CASE WHEN r.pu = 1 THEN l < n_hs ELSE h > n_hs END"
    beyond = "CASE WHEN r.pu = 1 THEN h > r.ep ELSE l < r.ep END"
    states = {
        "a14": wilder("tr", 14, "a14"), "a10": wilder("tr", 10, "a10"), "a50": wilder("tr", 50, "a50"), "p14": wilder("plus", 14, "p14"), "m14": wilder("minus", 14, "m14"),
        "dx": ("NULL", "100 * (" + div("abs(100 * n_p14 / n_a14 - 100 * n_m14 / n_a14)", "100 * n_p14 / n_a14 + 100 * n_m14 / n_a14", "0") + ")"), "adx": wilder("n_dx", 14, "adx", "NULL"),
        "hs": ("l", held), "tu": ("0", f"({turned})::INT"),
        "pu": ("1", "CASE WHEN n_tu = 1 THEN 1 - r.pu ELSE r.pu END"), "sar": ("l", "CASE WHEN n_tu = 0 THEN n_hs WHEN r.pu = 1 THEN greatest(r.ep, h, ph) ELSE least(r.ep, l, pl) END"),
        "ep": ("h", f"CASE WHEN n_tu = 1 THEN CASE WHEN r.pu = 1 THEN l ELSE h END WHEN {beyond} THEN CASE WHEN r.pu = 1 THEN h ELSE l END ELSE r.ep END"), "af": ("0.02", f"CASE WHEN n_tu = 1 THEN 0.02 WHEN {beyond} THEN least(r.af + 0.02, 0.2) ELSE r.af END"),
        "su": ("NULL", "CASE WHEN t.i < 10 THEN NULL WHEN t.i = 10 THEN (c >= mp)::INT WHEN r.su = 1 THEN (c >= r.fl)::INT ELSE (c > r.fu)::INT END"),
        "fu": ("NULL", "CASE WHEN t.i < 10 THEN NULL WHEN t.i = 10 OR pc >= r.fu THEN mp + 3 * n_a10 ELSE least(mp + 3 * n_a10, r.fu) END"), "fl": ("NULL", "CASE WHEN t.i < 10 THEN NULL WHEN t.i = 10 OR pc <= r.fl THEN mp - 3 * n_a10 ELSE greatest(mp - 3 * n_a10, r.fl) END"),
    }
    more = [{"pn": f"CASE WHEN pu IS NOT DISTINCT FROM {lag('pu')} THEN 0 ELSE 1 END"}, {"pr": over("sum(pn)", "all", 0)}]
    out = {
        "tx_pdi_14": head("100 * p14 / a14", 14), "tx_mdi_14": head("100 * m14 / a14", 14), "tx_adx_14": head("adx", 27), "tx_psar_gap": head("(c - sar) / c * 100", 4), "tx_psar_days": head(over("count(*)", "all", 0, "code, pr") + " * (2 * pu - 1)", 4),
        "tx_supertrend_gap": "(c - CASE WHEN su = 1 THEN fl ELSE fu END) / c * 100", "tx_natr_14": head("a14 / c * 100", 13), "tx_atr_ratio_14_50": head(div("a14", "a50"), 49), "tx_range_atr": head(div("rng", "a14"), 13),
    }
    return recursive([BASE, moves, direction], states, more, out)


def strengths() -> str:
    wilder = lambda x, n, name: _ema_state(x, f"(1.0 / {n})", name)
    layers = [BASE, {"d": "c - pc", "s": "sign(c - pc)"}, {"nw": f"CASE WHEN s IS NOT DISTINCT FROM {lag('s')} THEN 0 ELSE 1 END", "tr": TRUE_RANGE, "bp": "c - CASE WHEN pc IS NULL THEN l ELSE least(l, pc) END", "rate": gap("c", "pc"), "mh": roll("mp", 10, "max"), "ml": roll("mp", 10, "min")}]
    layers += [{"rn": over("sum(nw)", "all", 0), "raw": "2 * (" + div("mp - ml", "mh - ml", "0.5") + ") - 1"}, {"streak": over("count(*)", "all", 0, "code, rn") + " * s"}, {"ds": f"streak - {lag('streak')}"}]
    states = {f"{kind}{n}": wilder(f"greatest({sign}d, 0) + 0 * d", n, f"{kind}{n}") for n in (3, 9, 14, 25) for kind, sign in (("g", ""), ("f", "-"))}
    states |= {f"{kind}s": wilder(f"greatest({sign}ds, 0) + 0 * ds", 2, f"{kind}s") for kind, sign in (("g", ""), ("f", "-"))}
    states |= {"x0": ("0", "0.33 * raw + 0.67 * r.x1"), "x1": ("0", "CASE WHEN raw IS NULL THEN 0 WHEN abs(n_x0) > 0.99 THEN 0.999 * sign(n_x0) ELSE n_x0 END"), "y1": ("0", "CASE WHEN raw IS NULL THEN 0 ELSE 0.5 * ln((1 + n_x1) / (1 - n_x1)) + 0.5 * r.y1 END")}
    rsi = lambda n: head(f"CASE WHEN g{n} + f{n} > 0 THEN 100 * g{n} / (g{n} + f{n}) ELSE 50 END", n if n != "s" else 2)
    more = [{"r9": rsi(9), "r14": rsi(14), "r25": rsi(25), "r3": rsi(3), "rs": rsi("s")}, {"rl": roll("r14", 14, "min"), "rh": roll("r14", 14, "max")}]
    part = lambda n: "(" + div(roll("bp", n, "sum"), roll("tr", n, "sum"), "0.5") + ")"
    spearman = lambda n: (
        f"CASE WHEN i >= {n} THEN 100 * (" + div(f"list_sum(list_transform(k{n}, lambda q, j: (q - {(n + 1) / 2}) * (j - {(n + 1) / 2})))", f"sqrt(list_sum(list_transform(k{n}, lambda q: pow(q - {(n + 1) / 2}, 2))) * {n * (n * n - 1) / 12})", "0") + ") END"
    )
    more += [{f"w{n}": over("list(c)", 1 - n, 0) for n in (9, 26)} | {"rates": over("list(rate)", -100, -1)}, {f"k{n}": f"list_transform(w{n}, lambda x: len(list_filter(w{n}, lambda y: y < x)) + (len(list_filter(w{n}, lambda y: y = x)) + 1) / 2)" for n in (9, 26)}]
    out = {
        "tx_rsi_9": "r9", "tx_rsi_14": "r14", "tx_rsi_25": "r25", "tx_stoch_rsi_14": "100 * (" + div("r14 - rl", "rh - rl", "0.5") + ")", "tx_connors_rsi": head("(r3 + rs + len(list_filter(rates, lambda y: y < rate))) / 3", 101),
        "tx_fisher_10": "CASE WHEN i >= 10 THEN y1 END", "tx_rci_9": spearman(9), "tx_rci_26": spearman(26), "tx_ultimate_osc": f"100 * (4 * {part(7)} + 2 * {part(14)} + {part(28)}) / 7",
    }
    return recursive(layers, states, more, out)


def ranges() -> str:
    span = lambda x, n, name, first=None: _ema_state(x, f"(2.0 / {n + 1})", name, first)
    wilder = lambda x, n, name: _ema_state(x, f"(1.0 / {n})", name)
    layers = [BASE, {"tr": TRUE_RANGE, "mf": "(" + div("(c - l) - (h - c)", "rng", "0") + ") * v", "m20": roll("c", 20), "sd20": roll("c", 20, "stddev_pop"), "gk": "0.5 * pow(ln(h / l), 2) - (2 * ln(2) - 1) * pow(ln(c / o), 2)", "quiet": "CASE WHEN v < pv THEN ln(c / pc) ELSE 0 END", "v20": roll("v", 20)}]
    layers += [{"ad": over("sum(mf)", "all", 0), "width": div("4 * sd20", "m20"), "ease": div(f"(mp - {lag('mp')}) / c * 100 * (rng / c * 100)", "v / v20", "0")}]
    states = {"a10": wilder("tr", 10, "a10"), "a20": wilder("tr", 20, "a20"), "e20": span("c", 20, "e20"), "s10": span("rng", 10, "s10"), "e9": span("rng", 9, "e9"), "e99": span("n_e9", 9, "e99", "rng"), "d3": span("ad", 3, "d3"), "d10": span("ad", 10, "d10")}
    more = [{"ratio": div("e9", "e99", "1"), "widths": over("list(width)", -119, 0)}]
    out = {
        "tx_keltner_pos": head("100 * (" + div("c - (e20 - 2 * a10)", "4 * a10", "0.5") + ")", 19), "tx_squeeze": head("(2 * sd20 < 1.5 * a20)::INT", 19), "tx_chaikin_vol_10": head(gap("s10", lag("s10", 10)), 19), "tx_mass_index_25": head(roll("ratio", 25, "sum"), 41), "tx_chaikin_osc": head(div("d3 - d10", roll("v", 10)), 9),
        "tx_bb_width_rank_120": "CASE WHEN i >= 139 THEN 100 * (len(list_filter(widths, lambda y: y < width)) + (len(list_filter(widths, lambda y: y = width)) + 1) / 2) / 120 END", "tx_vol_gk_20": f"sqrt(greatest({roll('gk', 20)}, 0) + 0 * ({roll('gk', 20)}))", "tx_eom_14": head(roll("ease", 14), 33),
        "tx_nvi_chg_60": head(f"(exp({roll('quiet', 60, 'sum')}) - 1) * 100", 60),
    }
    out["tx_vol_gk_20"] = f"100 * {out['tx_vol_gk_20']}"
    return recursive(layers, states, more, out)


RECURSIVE = {"averages": averages, "trends": trends, "strengths": strengths, "ranges": ranges}


def all_recursive() -> str:
    parts = [f"({build()}) AS q{i}" for i, build in enumerate(RECURSIVE.values())]
    return "SELECT * FROM " + parts[0] + "".join(f" JOIN {p} USING (code, day)" for p in parts[1:])


def price_panel() -> str:
    return "WITH " + BARS + f""",
p AS (SELECT *, CASE WHEN {ROW} >= 368 AND {over("count(c)", -367, 0)} >= 184 THEN {over("max(c)", -367, 0)} END AS high_n FROM bars),
q AS (SELECT *, {lag("high_n")} AS prior_high FROM p),
n AS (SELECT *, coalesce(c > prior_high, false) AS new_high FROM q)
SELECT code, day, c, prior_high, new_high, new_high AND NOT coalesce({over("max(new_high)", -20, -1)}, false) AS fresh_break FROM n"""


def forward_label() -> str:
    ahead = lambda a: f"CASE WHEN {over('count(c)', 1, 20)} >= 20 THEN {over(f'{a}(c)', 1, 20)} END"
    return "WITH " + BARS + f""",
f AS (SELECT *, lead(o) OVER w AS entry, {ahead("max")} AS max_ahead, {ahead("min")} AS min_ahead, lead(c, 20) OVER w AS end_close, {over("list(c)", 1, 20)} AS cs FROM bars WINDOW w AS (PARTITION BY code ORDER BY day))
SELECT code, day, entry, max_ahead, min_ahead, end_close,
  CASE WHEN max_ahead IS NOT NULL THEN len(list_filter(cs, lambda x: x > c)) END AS above_ahead, max_ahead >= entry * (1 + 0.1) AND end_close > entry AS label FROM f"""


def drawdown() -> str:
    return "WITH " + BARS + f""",
i AS (SELECT *, {ROW} AS i FROM bars)
SELECT code, day, round((c / {over("max(c)", -119, 0)} - 1) * 100, 4) AS depth, i - {over("arg_max(i, (c, i))", -119, 0)} AS high_age FROM i"""
