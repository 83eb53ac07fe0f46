"""key=value options of a run; keys are lower-cased and lose their dashes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from keyloom.plans.planner import Config, parse_bool, parse_count, parse_counts
from keyloom.sources.modes import MODES, parse_modes, row_count


@dataclass(frozen=True)
class Options:
    modes: tuple[str, ...] = ("RANDOM",)
    records: tuple[int, ...] = (1_000_000,)
    sweep: bool = False
    sweep_records: int = 100_000
    signed: bool = False
    prescan: bool = True
    runs: int = 3
    warmups: int = 1
    algorithms: tuple[str, ...] = ("total_order", "positions")
    #: Partitions of the input; 0: the session's own number. `threads` sets it too.
    partitions: int = 0
    stealing: bool = True
    #: Items that a worker claims at a time in the schedule; 0: half of the workers, 4 at least.
    work_batch: int = 0
    tune_records: int = 0
    warmup_records: int = 0
    config: Config = field(default_factory=Config)

    def cases(self) -> list[tuple[str, int]]:
        """(mode, rows) of all runs; a sweep has every mode once."""
        if self.sweep:
            return [(m, row_count(m, self.sweep_records)) for m in MODES]
        return [(m, row_count(m, n)) for n in self.records for m in self.modes]


def _config(text: str, base: Config) -> Config:
    msd, lsd, tiny = (parse_count(x) for x in text.split(","))
    return replace(base, msd_bits=msd, lsd_bits=lsd, tiny=tiny)


#: Names that set a field of Config, with their readers.
CONFIG = {
    "tuplebits": ("tuple_bits", parse_count), "contiguoustuplebits": ("contiguous_tuple_bits", parse_count), "directtupleinplacemax": ("in_place_rows", parse_count),
    "directtuplemanypartitions": ("many_tuples", parse_count), "tuplepacking": ("packing", parse_bool), "staggertuples": ("stagger", parse_bool), "staggertuplebits": ("stagger_bits", parse_count),
    "staggertuplecostmodel": ("stagger_cost", parse_bool), "staggertupleminrecords": ("stagger_min_rows", parse_count), "localmsdbits": ("local_bits", parse_count),
    "localmsd": ("local", parse_bool), "localmsdminrecords": ("local_min_rows", parse_count), "localmsdminpasses": ("local_min_passes", parse_count), "localmsdminwindowbits": ("local_min_window", parse_count), "localmsdminsharedivisor": ("local_share", parse_count),
    "dominantcore": ("core", parse_bool), "localmsdmaxchildren": ("local_children", parse_count), "heapscratch": ("heap_rows", parse_count), "dominantcoreminshare": ("core_share", parse_count),
    "dominantcorekeyminsharedivisor": ("core_divisor", parse_count), "dominantcoresample": ("core_sample", parse_count), "dominantcorecandidates": ("core_candidates", parse_count),
}
#: Names that only steer a native sorter's own loops; there is nothing here for them to set.
PHYSICAL = ("descendingscatter", "largepermits", "lsdheapunroll", "lsdheapunrollminrecords")
ALIASES = {"mode": "modes", "record": "records", "n": "records", "locked": "config", "signedkeys": "signed", "orderfastpath": "prescan", "algos": "algorithms", "warmup": "warmups", "keys": "keyorder"}


def parse(args: list[str]) -> Options:
    """Options of key=value words, or of the positional form MODE COUNT MSD LSD TINY."""
    out = Options()
    if args and all("=" not in a for a in args):
        names = ("modes", "records")
        args = [f"{k}={v}" for k, v in zip(names, args)] + ([f"config={','.join(args[2:5])}"] if len(args) == 5 else [])
    for a in args:
        key, _, value = a.partition("=")
        key = key.lower().replace("-", "").replace("_", "")
        key = ALIASES.get(key, key)
        if key == "modes":
            out = replace(out, modes=tuple(parse_modes(value)))
        elif key == "records":
            out = replace(out, records=tuple(parse_counts(value)))
        elif key == "sweep":
            out = replace(out, sweep=parse_bool(value))
        elif key == "sweeprecords":
            out = replace(out, sweep_records=parse_count(value))
        elif key in ("signed", "prescan"):
            out = replace(out, **{key: parse_bool(value)})
        elif key == "keyorder":
            if value.lower() not in ("signed", "unsigned"):
                raise ValueError(f"key order {value!r}")
            out = replace(out, signed=value.lower() == "signed")
        elif key in ("runs", "warmups", "partitions"):
            out = replace(out, **{key: parse_count(value)})
        elif key == "algorithms":
            out = replace(out, algorithms=tuple(x.strip() for x in value.split(",")))
        elif key == "config":
            out = replace(out, config=_config(value, out.config))
        elif key == "curated":
            out = replace(out, algorithms=("curated",) if parse_bool(value) else ("all",))
        elif key == "threads":
            out = replace(out, partitions=0 if value.lower() == "auto" else parse_count(value))
        elif key == "workstealing":
            out = replace(out, stealing=parse_bool(value))
        elif key in ("workbatch", "tunerecords", "warmuprecords"):
            out = replace(out, **{{"workbatch": "work_batch", "tunerecords": "tune_records", "warmuprecords": "warmup_records"}[key]: parse_count(value)})
        elif key in ("msd", "lsd", "tiny"):
            out = replace(out, config=replace(out.config, **{"tiny" if key == "tiny" else f"{key}_bits": parse_count(value)}))
        elif key in PHYSICAL:
            raise ValueError(f"{key} steers loops that Spark has of its own; leave it out")
        elif key in CONFIG:
            name, read = CONFIG[key]
            out = replace(out, config=replace(out.config, **{name: read(value)}))
        else:
            raise ValueError(f"unknown option {a!r}")
    if out.runs < 1 or out.warmups < 0 or min(out.records) < 0:
        raise ValueError("runs are at least 1, warm-ups and records at least 0")
    if not (1 <= out.config.msd_bits <= 16 and 1 <= out.config.lsd_bits <= 17 and out.config.tiny >= 1):
        raise ValueError("a width is out of range")
    return out
