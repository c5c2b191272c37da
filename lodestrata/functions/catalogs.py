"""Feature catalogs: lists of named formulas, built from families and windows."""

from __future__ import annotations

WINDOWS = (5, 10, 20, 30, 60)

#: Shapes of one bar.
_RANGE = "($high-$low+1e-12)"
_PARTS = {"KMID": "$close-$open", "KUP": "$high-Greater($open,$close)", "KLOW": "Less($open,$close)-$low", "KSFT": "2*$close-$high-$low"}


def bar_shapes() -> dict[str, str]:
    out = {"KLEN": "($high-$low)/$open"}
    for name, part in _PARTS.items():
        out[name] = f"({part})/$open"
        out[name + "2"] = f"({part})/{_RANGE}"
    return out


def _ups(x: str, d: int, name: str) -> dict[str, str]:
    """Sums of rises and falls as shares of all moves."""
    move = f"{x}-Ref({x},1)"
    up, down, total = f"Sum(Greater({move},0),{d})", f"Sum(Greater(Ref({x},1)-{x},0),{d})", f"(Sum(Abs({move}),{d})+1e-12)"
    return {f"{name}P{d}": f"{up}/{total}", f"{name}N{d}": f"{down}/{total}", f"{name}D{d}": f"({up}-{down})/{total}"}


def rolling_family(d: int) -> dict[str, str]:
    """The features of one window."""
    close, volume = "$close", "($volume+1e-12)"
    swing = f"Abs({close}/Ref({close},1)-1)*$volume"
    low, high = f"Min($low,{d})", f"Max($high,{d})"
    rise, fall = f"Mean({close}>Ref({close},1),{d})", f"Mean({close}<Ref({close},1),{d})"
    by_close = {"ROC": f"Ref({close},{d})", "MA": f"Mean({close},{d})", "STD": f"Std({close},{d})", "BETA": f"Slope({close},{d})", "RESI": f"Resi({close},{d})", "MAX": high, "MIN": low, "QTLU": f"Quantile({close},{d},0.8)", "QTLD": f"Quantile({close},{d},0.2)"}
    out = {f"{k}{d}": f"{v}/{close}" for k, v in by_close.items()}
    out |= {
        f"RSQR{d}": f"Rsquare({close},{d})",
        f"RANK{d}": f"Rank({close},{d})",
        f"RSV{d}": f"({close}-{low})/({high}-{low}+1e-12)",
        f"IMAX{d}": f"IdxMax($high,{d})/{d}",
        f"IMIN{d}": f"IdxMin($low,{d})/{d}",
        f"IMXD{d}": f"(IdxMax($high,{d})-IdxMin($low,{d}))/{d}",
        f"CORR{d}": f"Corr({close},Log($volume+1),{d})",
        f"CORD{d}": f"Corr({close}/Ref({close},1),Log($volume/Ref($volume,1)+1),{d})",
        f"CNTP{d}": rise,
        f"CNTN{d}": fall,
        f"CNTD{d}": f"{rise}-{fall}",
        f"VMA{d}": f"Mean($volume,{d})/{volume}",
        f"VSTD{d}": f"Std($volume,{d})/{volume}",
        f"WVMA{d}": f"Std({swing},{d})/(Mean({swing},{d})+1e-12)",
    }
    return out | _ups(close, d, "SUM") | _ups("$volume", d, "VSUM")


def catalog_158(windows: tuple[int, ...] = WINDOWS) -> dict[str, str]:
    """9 bar shapes, 4 prices and 29 families of each window."""
    out = bar_shapes() | {f"{f.upper()}0": f"${f}/$close" for f in ("open", "high", "low", "vwap")}
    for d in windows:
        out |= rolling_family(d)
    return out


def catalog_360(length: int = 60) -> dict[str, str]:
    """The last ``length`` values of six fields, prices by today's close and volumes by today's volume."""
    out = {}
    for f in ("close", "open", "high", "low", "vwap", "volume"):
        base = "($volume+1e-12)" if f == "volume" else "$close"
        for i in range(length - 1, -1, -1):
            out[f"{f.upper()}{i}"] = f"{f'Ref(${f},{i})' if i else f'${f}'}/{base}"
    return out


#: Returns that models learn.
LABELS = {"close": "Ref($close,-2)/Ref($close,-1)-1", "vwap": "Ref($vwap,-2)/Ref($vwap,-1)-1", "next": "Ref($close,-1)/$close-1"}


def minute_catalog(base: str = "$close") -> dict[str, str]:
    """Minute features: prices of trading minutes by the last price of the day before, volumes by their usual size."""
    live = lambda f: f"If(Gt($paused_num,0),$missing,{f})"
    last = f"Ref(DayLast(FFillNan({live(base)})),240)"
    out = {f: f"FFillNan({live('$' + f)})/{last}" for f in ("open", "high", "low", "close", "vwap")}
    out["volume"] = f"If(IsNull({live('$volume')}),0,{live('$volume')})/Ref(DayLast(Mean($volume,240)),240)"
    return out
