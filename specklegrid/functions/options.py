"""The catalogue of run options: types, defaults, choices, when an option applies, and the older flat names; with validation."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

GROUPS = ("input_data", "initial_support", "logging", "phasing_method", "support_update_method", "initial_image")

ALGORITHMS = "hio raar diff_map hpr cflip raar_cflip espresso haar so2d raar_proj hio_proj".split()
SUPPORT_ALGORITHMS = "threshold static stepped real_error_capped real_error_adaptative constant_area area complex_decreasing_area template_area".split()
STARTS = ["random phases", "random density", "zero phases", "starting support"]
CONSTANT = lambda v, end: ((0, v), (end, v))

# Names, types, defaults, choices (special values end with !) and flags (s: before a run, r: during it, a: advanced, e: experimental).
CURRENT: tuple[tuple[str, str, Any, list[str], str], ...] = (
    ("commandline", "string", "", [], ""),
    ("cur_iteration", "int", 0, [], ""),
    ("nthreads", "int", 1, [], "sa"),
    ("reconstruction_finished", "bool", False, [], ""),
    ("max_iterations", "int", 0, ["Infinity!"], "sra"),
    ("current_real_space_image", "image", None, [], "r"),
    ("current_support", "image", None, [], "r"),
    ("random_seed", "int", -1, ["auto!"], "sra"),
    ("debug_level", "int", 0, [], "sa"),
    ("phasing_engine", "choice", "automatic", ["automatic", "cpu", "cuda"], "sa"),
    ("input_data.intensities_file", "existing file", "", [], "s"),
    ("input_data.real_image_file", "existing file", "", [], "se"),
    ("input_data.intensities_std_dev_file", "existing file", "", [], "se"),
    ("input_data.autocorrelation_support_file", "existing file", "", [], "se"),
    ("input_data.solution_file", "existing file", "", [], "sre"),
    ("input_data.added_noise", "real", 0.0, ["off!"], "se"),
    ("input_data.beamstop_radius", "real", 0.0, ["off!"], "se"),
    ("initial_support.initial_support_image", "existing file", "", [], "s"),
    ("initial_support.autocorrelation_algorithm", "choice", "threshold", ["threshold", "area"], "sr"),
    ("initial_support.autocorrelation_threshold", "real", 0.04, [], "s"),
    ("initial_support.autocorrelation_area", "real", 0.1, [], "sr"),
    ("initial_support.autocorrelation_blur_radius", "real", 0.0, ["off!"], "sra"),
    ("logging.work_directory", "directory", ".", [], "s"),
    ("logging.remote_work_directory", "string", "", [], "sa"),
    ("logging.save_remote_files", "bool", False, [], "sa"),
    ("logging.logfile", "file", "run.log", [], "s"),
    ("logging.output_period", "int", 100, [], "sr"),
    ("logging.log_output_period", "int", 20, [], "sr"),
    ("logging.output_precision", "choice", "32", ["32", "64"], "sre"),
    ("phasing_method.algorithm", "choice", "hio", ALGORITHMS, "sr"),
    ("phasing_method.beta", "map", CONSTANT(0.9, 2000), [], "sr"),
    ("phasing_method.gamma1", "real", -10000.0, ["auto!"], "sr"),
    ("phasing_method.gamma2", "real", -10000.0, ["auto!"], "sr"),
    ("phasing_method.RAAR_sigma", "real", 0.0, [], "sre"),
    ("phasing_method.charge_flip_sigma", "real", 0.05, [], "sre"),
    ("phasing_method.espresso_tau", "real", 0.05, [], "sre"),
    ("phasing_method.enforce_positivity", "bool", False, [], "sr"),
    ("phasing_method.enforce_real", "bool", False, [], "sr"),
    ("phasing_method.enforce_centrosymmetry", "bool", False, [], "sre"),
    ("phasing_method.enforce_ramp", "bool", False, [], "sra"),
    ("phasing_method.remove_central_pixel_phase", "bool", False, [], "sre"),
    ("phasing_method.perturb_weak_reflections", "real", 0.0, ["No!"], "sr"),
    ("phasing_method.phases_blur", "map", CONSTANT(0.0, 5000), [], "sre"),
    ("phasing_method.image_blur_period", "int", 0, ["off!"], "sra"),
    ("phasing_method.image_blur_radius", "real", 0.0, [], "sra"),
    ("phasing_method.real_error_tolerance", "real", -1.0, ["off!"], "sre"),
    ("phasing_method.adapt_thres", "bool", False, [], "sre"),
    ("phasing_method.output_projection", "choice", "project_intensities", ["project_intensities", "no_projection"], "sra"),
    ("support_update_method.support_update_algorithm", "choice", "area", SUPPORT_ALGORITHMS, "sr"),
    ("support_update_method.support_intensity_threshold", "real", 0.2, [], "sr"),
    ("support_update_method.support_real_error_threshold", "real", -1.0, ["auto!"], "sre"),
    ("support_update_method.object_area", "map", CONSTANT(0.001, 2000), [], "sr"),
    ("support_update_method.template_area", "map", CONSTANT(1.0, 5000), [], "sr"),
    ("support_update_method.template_blur_radius", "real", 5.0, [], "sr"),
    ("support_update_method.blur", "map", ((0, 3.0), (5000, 0.7)), [], "sr"),
    ("support_update_method.innerloop_iterations", "int", 20, [], "sa"),
    ("support_update_method.error_reduction_iterations_in_support_update", "int", 0, [], "sra"),
    ("support_update_method.support_image_averaging", "int", 1, ["off!"], "sre"),
    ("support_update_method.support_closure_radius", "int", 0, ["off!"], "sre"),
    ("support_update_method.center_image", "bool", False, [], "sr"),
    ("support_update_method.square_mask", "real", 0.0, ["off!"], "sra"),
    ("support_update_method.filter_intensities", "bool", False, [], "sra"),
    ("support_update_method.fixed_support_mask", "existing file", "", [], "sa"),
    ("initial_image.image_guess", "existing file", "", [], "s"),
    ("initial_image.realspace_starting_point", "choice", "random phases", STARTS, "s"),
    ("initial_image.rescale_initial_image", "bool", True, [], "sre"),
)

# Older names, without a group, that are read but not written, and the path each stands for.
MOVED = {
    "amplitudes_file": "input_data.intensities_file",
    "real_image_file": "input_data.real_image_file",
    "intensities_std_dev_file": "input_data.intensities_std_dev_file",
    "autocorrelation_support_file": "input_data.autocorrelation_support_file",
    "added_noise": "input_data.added_noise",
    "beamstop_radius": "input_data.beamstop_radius",
    "initial_support_image": "initial_support.initial_support_image",
    "patterson_threshold": "initial_support.autocorrelation_threshold",
    "patterson_level_algorithm": "initial_support.autocorrelation_algorithm",
    "patterson_blur_radius": "initial_support.autocorrelation_blur_radius",
    "logfile": "logging.logfile",
    "output_period": "logging.output_period",
    "log_output_period": "logging.log_output_period",
    "output_precision": "logging.output_precision",
    "algorithm": "phasing_method.algorithm",
    "beta": "phasing_method.beta",
    "gamma1": "phasing_method.gamma1",
    "gamma2": "phasing_method.gamma2",
    "RAAR_sigma": "phasing_method.RAAR_sigma",
    "charge_flip_sigma": "phasing_method.charge_flip_sigma",
    "enforce_positivity": "phasing_method.enforce_positivity",
    "enforce_real": "phasing_method.enforce_real",
    "remove_central_pixel_phase": "phasing_method.remove_central_pixel_phase",
    "perturb_weak_reflections": "phasing_method.perturb_weak_reflections",
    "image_blur_period": "phasing_method.image_blur_period",
    "image_blur_radius": "phasing_method.image_blur_radius",
    "real_error_tolerance": "phasing_method.real_error_tolerance",
    "adapt_thres": "phasing_method.adapt_thres",
    "support_update_algorithm": "support_update_method.support_update_algorithm",
    "support_intensity_threshold": "support_update_method.support_intensity_threshold",
    "support_real_error_threshold": "support_update_method.support_real_error_threshold",
    "object_area": "support_update_method.object_area",
    "innerloop_iterations": "support_update_method.innerloop_iterations",
    "support_image_averaging": "support_update_method.support_image_averaging",
    "square_mask": "support_update_method.square_mask",
    "filter_intensities": "support_update_method.filter_intensities",
    "fixed_support_mask": "support_update_method.fixed_support_mask",
    "image_guess": "initial_image.image_guess",
    "rescale_amplitudes": "initial_image.rescale_initial_image",
}
# Older options that stand for a part of a schedule, or for nothing any more.
PARTS = {
    "max_blur_radius": ("support_update_method.blur", "first"),
    "maximum_blur_radius": ("support_update_method.blur", "first"),
    "minimum_blur_radius": ("support_update_method.blur", "last"),
    "iterations_to_min_blur": ("support_update_method.blur", "end"),
    "min_object_area": ("support_update_method.object_area", "last"),
    "iterations_to_min_object_area": ("support_update_method.object_area", "end"),
    "object_area_checkpoints": ("support_update_method.object_area", "keys"),
    "object_area_at_checkpoints": ("support_update_method.object_area", "values"),
    "beta_checkpoints": ("phasing_method.beta", "keys"),
    "beta_at_checkpoints": ("phasing_method.beta", "values"),
    "phases_max_blur_radius": ("phasing_method.phases_blur", "first"),
    "phases_min_blur_radius": ("phasing_method.phases_blur", "last"),
    "iterations_to_min_phases_blur": ("phasing_method.phases_blur", "end"),
}
IGNORED = "blur_radius_reduction_method dynamic_beta automatic genetic_optimization break_centrosym_period error_reduction_iterations_after_loop random_initial_phases random_initial_intensities initial_phases".split()
#: Older choices of the same meaning.
SAME_CHOICE = {"support_update_method.support_update_algorithm": {"fixed": "threshold", "decreasing_area": "area"}, "initial_support.autocorrelation_algorithm": {"fixed": "threshold", "constant_area": "area"}}

_ALG, _SUP, _AUTO = "phasing_method.algorithm", "support_update_method.support_update_algorithm", "initial_support.autocorrelation_algorithm"
_GIVEN = {"intensities_file": "input_data.intensities_file", "guess": "initial_image.image_guess", "support": "initial_support.initial_support_image"}
_WITH_POSITIVITY = {"raar", "hio", "hpr", "cflip", "diff_map"}
_WITH_AREA = {"constant_area", "area", "complex_decreasing_area"}


def _needs(v: dict[str, Any]) -> dict[str, bool]:
    """For the options that depend on others, whether they apply."""
    alg, sup = v[_ALG], v[_SUP]
    given = {k: bool(v[p]) for k, p in _GIVEN.items()}
    positive = alg in _WITH_POSITIVITY
    found = {
        "input_data.intensities_file": not given["guess"], "input_data.real_image_file": not given["intensities_file"], "input_data.intensities_std_dev_file": given["intensities_file"],
        "initial_image.realspace_starting_point": not given["guess"], _AUTO: not given["support"], "initial_support.autocorrelation_threshold": not given["support"] and v[_AUTO] == "threshold",
    }
    found |= dict.fromkeys(("initial_support.autocorrelation_area", "initial_support.autocorrelation_blur_radius"), not given["support"] and v[_AUTO] == "area")
    found |= {f"phasing_method.{k}": positive for k in ("enforce_positivity", "enforce_real", "enforce_centrosymmetry", "enforce_ramp")}
    found |= {f"phasing_method.{k}": alg == a for k, a in (("gamma1", "diff_map"), ("gamma2", "diff_map"), ("RAAR_sigma", "raar"), ("charge_flip_sigma", "cflip"), ("espresso_tau", "espresso"))}
    found |= {"phasing_method.beta": alg in {"raar", "hio", "hpr", "raar_proj", "hio_proj", "diff_map", "espresso"}, "phasing_method.perturb_weak_reflections": alg in {"raar", "cflip"}}
    method = {"support_intensity_threshold": sup in {"threshold", "stepped"}, "support_real_error_threshold": sup in {"real_error_adaptative", "real_error_capped"}, "blur": sup != "template_area"}
    method |= dict.fromkeys(("object_area", "center_image"), sup in _WITH_AREA) | dict.fromkeys(("template_area", "template_blur_radius"), sup == "template_area")
    return found | {f"support_update_method.{k}": x for k, x in method.items()}


_TYPES = {path: (kind, [c for c in choices if not c.endswith("!")], [c[:-1] for c in choices if c.endswith("!")]) for path, kind, _, choices, _ in CURRENT}


def defaults() -> dict[str, Any]:
    return {path: value for path, _, value, _, _ in CURRENT}


def _is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _as_map(v) -> tuple[tuple[float, float], ...] | None:
    """A schedule: a number, or ([keys], [values])."""
    if _is_number(v):
        return ((0, v),)
    if isinstance(v, (list, tuple)) and len(v) == 2 and all(isinstance(x, (list, tuple)) and all(map(_is_number, x)) for x in v) and len(v[0]) == len(v[1]) > 0:
        return tuple(sorted(zip(v[0], v[1], strict=True)))
    return None


def checked(path: str, v: Any) -> Any:
    """The value in the option's type; a ValueError says what it should be."""
    kind, choices, special = _TYPES[path]
    if isinstance(v, str) and v in special:
        return dict(CURRENT_DEFAULTS)[path]
    if kind == "choice":
        v = SAME_CHOICE.get(path, {}).get(str(v), str(v))
        if v not in choices:
            raise ValueError(f"{path} is one of {', '.join(choices)}, not {v}")
        return v
    if kind == "map":
        if (m := _as_map(v)) is None:
            raise ValueError(f"{path} is a number or ([keys], [values])")
        return m
    if kind == "bool" and (isinstance(v, bool) or v in (0, 1)):
        return bool(v)
    if kind == "int" and _is_number(v) and float(v).is_integer():
        return int(v)
    if kind == "real" and _is_number(v):
        return float(v)
    if kind in ("string", "file", "existing file", "directory", "image") and isinstance(v, str):
        return v
    raise ValueError(f"{path} is of type {kind}, not {v!r}")


CURRENT_DEFAULTS = tuple(defaults().items())


@dataclass(frozen=True)
class Options:
    values: dict[str, Any]  # of every option, by path
    given: tuple[str, ...]  # those that the configuration sets
    problems: tuple[str, ...]  # unknown names and values that are not valid: the default stands
    warnings: tuple[str, ...]  # older names, and options that don't apply

    def __getitem__(self, path: str) -> Any:
        return self.values[path]

    def applies(self, path: str) -> bool:
        return _needs(self.values).get(path, True)


def _flat(config: dict, at: str = "") -> list[tuple[str, Any]]:
    return [y for k, v in config.items() for y in (_flat(v, f"{at}{k}.") if isinstance(v, dict) else [(f"{at}{k}", v)])]


def _with_part(m: tuple, part: str, v, end: float) -> tuple:
    """A schedule (a constant lasts to `end`) with its first or last value, its end, or its keys or values replaced."""
    if part in ("keys", "values"):
        new = list(v) if isinstance(v, (list, tuple)) else [v]
        if not new or not all(map(_is_number, new)):
            raise ValueError("a list of numbers is expected")
        old = [x[part == "keys"] for x in m]
        old += [old[-1]] * (len(new) - len(old))
        return tuple(zip(*((new, old[: len(new)]) if part == "keys" else (old[: len(new)], new)), strict=True))
    if not _is_number(v):
        raise ValueError("a number is expected")
    m = m if len(m) > 1 else (m[0], (end, m[0][1]))
    return {"first": ((m[0][0], v), *m[1:]), "last": (*m[:-1], (m[-1][0], v)), "end": (*m[:-1], (v, m[-1][1]))}[part]


def load(config: dict) -> Options:
    """Options of a parsed configuration (text.parse_config): grouped names, older flat ones, and defaults for the rest."""
    values, given, problems, warnings = defaults(), [], [], []
    for name, v in _flat(config):
        short = name.rpartition(".")[2]
        path = name if name in values else MOVED.get(name)
        try:
            if path:
                values[path] = checked(path, v)
                given.append(path)
                if path != name:
                    warnings.append(f"{name} is now {path}")
            elif short in PARTS:
                path, part = PARTS[short]
                values[path] = _with_part(values[path], part, v, defaults()[path][-1][0])
                given.append(path)
                warnings.append(f"{name} is now a part of {path}")
            elif short in IGNORED:
                warnings.append(f"{name} has no effect any more")
            else:
                problems.append(f"no such option: {name}")
        except ValueError as e:
            problems.append(str(e) if path in str(e) else f"{name}: {e}")
    apply = _needs(values)
    warnings += [f"{p} has no effect with these settings" for p in dict.fromkeys(given) if not apply.get(p, True)]
    return Options(values, tuple(dict.fromkeys(given)), tuple(problems), tuple(warnings))


def dump(options: Options) -> dict:
    """The nested configuration of all current options, for text.write_config; schedules as keys and values."""
    out: dict[str, Any] = {}
    for path, v in options.values.items():
        if _TYPES[path][0] == "image":
            continue
        group, _, name = path.rpartition(".")
        v = [[k for k, _ in v], [x for _, x in v]] if _TYPES[path][0] == "map" else v
        (out.setdefault(group, {}) if group else out)[name] = v
    return out


def changed(options: Options, updates: dict[str, Any]) -> Options:
    """For the next chunk of a run: only options that may be set during a run change; others raise."""
    free = {path for path, _, _, _, flags in CURRENT if "r" in flags}
    for path in updates:
        if path not in free:
            raise ValueError(f"{path} can't be set during a run")
    return Options(options.values | {p: checked(p, v) for p, v in updates.items()}, options.given, options.problems, options.warnings)


def catalogue(spark: SparkSession) -> DataFrame:
    """A row for each option: path, type, default (JSON), choices, and when it may be set."""
    rows = [(p, k, json.dumps(v), c, "s" in f, "r" in f, "a" in f, "e" in f, False) for p, k, v, c, f in CURRENT]
    rows += [(p, "moved", json.dumps(to), [], True, False, False, False, True) for p, to in MOVED.items()]
    return spark.createDataFrame(rows, "path string, type string, value string, choices array<string>, before_run boolean, during_run boolean, advanced boolean, experimental boolean, deprecated boolean")


def validate(configs: DataFrame) -> DataFrame:
    """configs(config_id, text): path, value (JSON), given, applies of all options of each text, and its problems as rows without a path. One pass, no shuffle."""
    import pandas as pd

    from ..sources.text import parse_config

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    o = load(parse_config(r.text or ""))
                except ValueError as e:
                    out.append((r.config_id, None, str(e), False, False))
                    continue
                apply = _needs(o.values)
                out += [(r.config_id, p, json.dumps(v), p in o.given, apply.get(p, True)) for p, v in o.values.items()]
                out += [(r.config_id, None, x, False, False) for x in o.problems]
            yield pd.DataFrame(out, columns=["config_id", "path", "value", "given", "applies"])

    return configs.select("config_id", "text").mapInPandas(run, "config_id long, path string, value string, given boolean, applies boolean")
