"""Whole configurations of robots: from a dataset's columns to a model's inputs, and back to the robot's actions.

A sample is a row. What a robot's data call their columns is repacked first (in
training only); its inputs give ``state``, ``image`` and ``image_mask`` by slot,
and ``actions`` and ``prompt`` if they are there; its outputs take the robot's own
dimensions out of what the model gives.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.functions import texts, vectors
from kinelake.operators import project
from kinelake.operators.project import Group, Transform
from kinelake.plans import pipelines
from kinelake.plans.pipelines import DataConfig

#: What each dataset's columns become.
REPACK: dict[str, Mapping] = {
    "libero": {"observation": {"image": "image", "wrist_image": "wrist_image", "state": "state"}, "actions": "actions", "prompt": "prompt"},
    "droid_rlds": {
        "observation": {"exterior_image_1_left": "observation/image", "wrist_image_left": "observation/wrist_image", "joint_position": "observation/joint_position", "gripper_position": "observation/gripper_position"},
        "actions": "actions",
        "prompt": "prompt",
    },
    "droid": {
        "observation": {"exterior_image_1_left": "exterior_image_1_left", "exterior_image_2_left": "exterior_image_2_left", "wrist_image_left": "wrist_image_left", "joint_position": "joint_position", "gripper_position": "gripper_position"},
        "actions": "actions",
        "prompt": "prompt",
    },
    "aloha": {"images": {"cam_high": "observation/images/top"}, "state": "observation/state", "actions": "action"},
}
#: The dimensions of each robot's own actions, and those of the two-arm robot that are grippers.
OUT_DIMS, ALOHA_GRIPPERS = {"libero": 7, "droid": 8, "droid_rlds": 8, "aloha": 14}, (6, 13)
#: The side of a model's square images.
SIDE = 224


def columns(df: DataFrame) -> dict[str, Column]:
    """Path to column of all that a sample holds, whole groups too, as an image may be one."""

    def walk(schema: T.StructType, above: tuple[str, ...]) -> dict[str, Column]:
        found = {}
        for f in schema.fields:
            path = (*above, f.name)
            found["/".join(path)] = F.col(".".join(f"`{p}`" for p in path))
            if isinstance(f.dataType, T.StructType):
                found |= walk(f.dataType, path)
        return found

    return walk(df.schema, ())


def blank(image: Column, kind: T.DataType) -> Column:
    """An image of zeros, as large as another: of bytes, of nested arrays of numbers, or of a group that holds either."""
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.repeat(F.lit("00"), F.octet_length(image).cast("int")))
    if isinstance(kind, T.ArrayType):
        return F.transform(image, lambda x: blank(x, kind.elementType))
    if isinstance(kind, T.StructType):  # its sizes stay
        return F.struct(*((blank(image[f.name], f.dataType) if isinstance(f.dataType, (T.BinaryType, T.ArrayType)) else image[f.name]).alias(f.name) for f in kind.fields))
    return F.lit(0).cast(kind)


def slots(df: DataFrame, found: Mapping[str, tuple[str | None, bool]], base: str) -> list[Column]:
    """``image`` and ``image_mask``: slot to (path of its image or None, mask). A slot without image is blank, the size of ``base``."""
    own = columns(df)
    kind = df.select(own[base].alias("x")).schema["x"].dataType
    image = [(F.lit(slot), own[path] if path else blank(own[base], kind)) for slot, (path, _) in found.items()]
    mask = [(F.lit(slot), F.lit(on)) for slot, (_, on) in found.items()]
    return [F.create_map(*(x for p in image for x in p)).alias("image"), F.create_map(*(x for p in mask for x in p)).alias("image_mask")]


def _rest(df: DataFrame, *, without: Sequence[str] = ()) -> list[Column]:
    """What passes through: actions and prompt, if they are there, and columns that belong to no observation."""
    return [F.col(f"`{c}`") for c in df.columns if c not in {"observation", "images", "state", "image", "image_mask", *without}]


def libero_inputs(model: str) -> Transform:
    """Two cameras; the right wrist's is blank, and masked off but for the fast model."""

    def run(df: DataFrame) -> DataFrame:
        found = {"base_0_rgb": ("observation/image", True), "left_wrist_0_rgb": ("observation/wrist_image", True), "right_wrist_0_rgb": (None, model == "fast")}
        return df.select(F.col("observation.state").alias("state"), *slots(df, found, "observation/image"), *_rest(df))

    return run


def droid_inputs(model: str) -> Transform:
    """Joints and gripper (a number or a vector) are the state; names of slots go by the model, and the fast one's blank isn't masked off."""

    def run(df: DataFrame) -> DataFrame:
        base, wrist = "observation/exterior_image_1_left", "observation/wrist_image_left"
        found = {slot: ({"base_0_rgb": base, "left_wrist_0_rgb": wrist, "wrist_0_rgb": wrist}.get(slot), on) for slot, on in project.DROID_SLOTS["fast" if model == "fast" else "flow"]}
        gripper = columns(df)["observation/gripper_position"]
        if not isinstance(df.select(gripper.alias("g")).schema["g"].dataType, T.ArrayType):
            gripper = F.array(gripper)
        return df.select(project.joined(F.col("observation.joint_position"), gripper).alias("state"), *slots(df, found, base), *_rest(df))

    return run


def _grippers(x: Column, fn: Callable[[Column], Column]) -> Column:
    return F.transform(x, lambda v, i: F.when(i.isin(*ALOHA_GRIPPERS), fn(v)).otherwise(v))


def aloha_inputs(adapt: bool = True) -> Transform:
    """The base camera must be there, the wrists' may; others are errors. ``adapt``: joints and grippers in the model's own conventions."""

    def run(df: DataFrame) -> DataFrame:
        cameras = [f.name for f in df.schema["images"].dataType.fields]
        if (extra := set(cameras) - set(project.ALOHA_CAMERAS)) or project.ALOHA_CAMERAS[0] not in cameras:
            raise ValueError(f"cameras {sorted(cameras)}: unexpected {sorted(extra)}, or without {project.ALOHA_CAMERAS[0]}")
        found = {slot: (f"images/{c}" if c in cameras else None, c in cameras) for slot, c in (("base_0_rgb", "cam_high"), ("left_wrist_0_rgb", "cam_left_wrist"), ("right_wrist_0_rgb", "cam_right_wrist"))}
        state, actions = F.col("state"), F.col("actions") if "actions" in df.columns else None
        if adapt:
            state = _grippers(vectors.flip_joints(state), vectors.gripper_to_angular)
            actions = None if actions is None else F.transform(actions, lambda a: _grippers(vectors.flip_joints(a), vectors.gripper_from_angular_inv))
        moved = [] if actions is None else [actions.alias("actions")]
        return df.select(state.alias("state"), *slots(df, found, "images/cam_high"), *moved, *_rest(df, without=("actions",)))

    return run


def outputs(robot: str, adapt: bool = True) -> Transform:
    """The robot's own dimensions of a model's actions, in its own conventions."""

    def run(df: DataFrame) -> DataFrame:
        actions = vectors.first_dims(F.col("actions"), OUT_DIMS[robot])
        if robot == "aloha" and adapt:
            actions = F.transform(actions, lambda a: _grippers(vectors.flip_joints(a), vectors.gripper_from_angular))
        return df.withColumn("actions", actions)

    return run


def resized(side: int = SIDE) -> Transform:
    """``image_fit``: for each slot whose image has a ``height`` and a ``width``, the sizes and padding of its resize to a square."""

    def run(df: DataFrame) -> DataFrame:
        kind = df.schema["image"].dataType.valueType if "image" in df.columns else None
        if not isinstance(kind, T.StructType) or not {"height", "width"} <= set(kind.names):
            return df
        fit = F.transform_values("image", lambda _, v: F.struct(*(c.alias(k) for k, c in texts.resize_with_pad(v["height"], v["width"], side, side).items())))
        return df.withColumn("image_fit", fit)

    return run


def tokenized(tokenize: Callable[[Column], Column], most: int, postfix: Callable[[Column], Column] | None = None) -> Transform:
    """``tokens`` and ``token_mask`` of ``prompt_text``, cut or filled to ``most``.

    ``postfix`` gives the tokens of ``actions`` where those are there, which follow
    the prompt's; then ``ar_mask`` and ``loss_mask`` are on over them.
    """

    def run(df: DataFrame) -> DataFrame:
        prefix = tokenize(F.col("prompt_text")).cast("array<bigint>")
        after = postfix(F.col("actions")).cast("array<bigint>") if postfix and "actions" in df.columns else F.array().cast("array<bigint>")
        rows = df.withColumns({"__prefix": prefix, "__postfix": after})
        whole, ones = F.concat("__prefix", "__postfix"), F.transform(F.concat("__prefix", "__postfix"), lambda _: F.lit(1).cast("long"))
        out = {"tokens": texts.fit_tokens(whole, most), "token_mask": texts.fit_tokens(ones, most)}
        if postfix:
            ar, loss = texts.token_masks(F.col("__prefix"), F.col("__postfix"))
            out |= {"ar_mask": texts.fit_tokens(ar, most), "loss_mask": texts.fit_tokens(loss, most)}
        return rows.withColumns(out).drop("__prefix", "__postfix")

    return run


def model_group(model: str, dim: int = 32, prompt: str | None = None, *, tokenizer: str | None = "bytes", most_tokens: int = 200, postfix: Callable[[Column], Column] | None = None, side: int = SIDE) -> Group:
    """What a model takes: a prompt, images' sizes, tokens (of the registered ``tokenizer``; None: the text alone), padding."""
    steps = [resized(side), pipelines.model_inputs(model, dim, prompt)]
    if tokenizer:
        steps.append(lambda df: tokenized(pipelines.TOKENIZERS[tokenizer], most_tokens, postfix if model == "fast" else None)(df))
    return Group(inputs=tuple(steps))


def robot_config(robot: str, model: str, stats: dict, *, delta: bool = True, adapt: bool = True, dim: int = 32, prompt: str | None = None, repack: Mapping | None = None, **options) -> DataConfig:
    """The usual configuration of ``libero``, ``droid_rlds``, ``droid`` (velocities), or ``aloha``; quantiles normalise for every model but ``flow``.

    ``delta``: of ``libero`` and ``droid_rlds`` (positions) and ``aloha``, actions are
    relative to the state; ``droid`` has velocities, which never are. Options: as
    of ``model_group``.
    """
    if robot not in REPACK:
        raise KeyError(f"{robot} (there are: {', '.join(REPACK)})")
    inputs = {"libero": libero_inputs(model), "droid": droid_inputs(model), "droid_rlds": droid_inputs(model), "aloha": aloha_inputs(adapt)}[robot]
    data = Group(inputs=(inputs,), outputs=(outputs(robot, adapt),))
    dims = pipelines.DELTA_DIMS[{"droid_rlds": "droid_position", "droid": "droid_velocity"}.get(robot, robot)]
    if dims and delta:
        mask = vectors.make_bool_mask(*dims)
        data = data.push(inputs=[pipelines.shift_actions(mask, -1)], outputs=[pipelines.shift_actions(mask, 1)])
    structure = repack or REPACK[robot]
    take = Group(inputs=(lambda df: kept_repack(df, structure),))
    return DataConfig(repack=take, data=data, model=model_group(model, dim, prompt, **options), stats=stats, quantile=model != "flow")


def kept_repack(df: DataFrame, structure: Mapping) -> DataFrame:
    """``structure`` of the data, without ``actions`` and ``prompt`` if they lack those, and with the rows' own keys (``*_id``)."""
    own = columns(df)
    wanted = {c: c for c in df.columns if c.endswith("_id") or c == "prompt"}

    def walk(node: Mapping, above: str = "") -> None:
        for k, v in node.items():
            if isinstance(v, Mapping):
                walk(v, f"{above}{k}/")
            elif v in own or f"{above}{k}" not in ("actions", "prompt"):
                wanted[f"{above}{k}"] = v

    walk(structure)
    if missing := [v for v in wanted.values() if v not in own]:
        raise KeyError(f"{missing} (there are: {', '.join(own)})")
    return df.select(*project.nest({k: own[v] for k, v in wanted.items()}))


def simple_config(data: Group, model: Group, stats: dict | None = None, quantile: bool = False) -> DataConfig:
    """Groups of one's own."""
    return DataConfig(data=data, model=model, stats=stats or {}, quantile=quantile)
