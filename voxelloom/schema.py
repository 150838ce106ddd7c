"""Table schemas and the patch-size value class shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import types as T

KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType()),
}


def table(*fields: str) -> T.StructType:
    """A schema from "name type" texts; needs no running session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (f.split() for f in fields)])


SAMPLES = table("volume_id string", "x int", "y int", "z int", "amp float")
TRACES = table("volume_id string", "x int", "y int", "amps array<float>")
DIMS = table("volume_id string", "nx int", "ny int", "nz int")
PATCHES = table("example_id bigint", "cube array<float>")
WINDOWS = table("volume_id string", "wx int", "wy int", "wz int")
SCORES = table("volume_id string", "wx int", "wy int", "wz int", "sim double")
CHUNK_MAP = table(
    "file string", "volume_id string", "cx int", "cy int", "cz int", "x0 int", "x1 int", "y0 int", "y1 int", "z0 int", "z1 int",
    "parts bigint", "n bigint", "mean double", "square double", "least double", "most double",
)
SNAPSHOTS = table("run_id string", "epoch int", "example_id bigint", "recon_loss double")
JOB_EVENTS = table(
    "job_id bigint", "ts timestamp", "kind string", "message string", "total_windows bigint",
    "completed_windows bigint", "eta_seconds double", "artifact_path string",
)

# The column names of the run log.
RUN_METRICS = table(
    "epoch int", "examples_this_epoch bigint", "cumulative_examples bigint", "train_loss double",
    "val_loss double", "kl_weight double", "learning_rate double", "discriminator_learning_rate double",
    "gan_weight double", "g_gan_loss double", "d_gan_loss double", "d_gan_acc_pct double", "best_model string",
)


@dataclass(frozen=True)
class PatchShape:
    """Patch extent along x, y and z; one value means a cube."""

    x: int
    y: int
    z: int

    @classmethod
    def of(cls, size) -> "PatchShape":
        if isinstance(size, cls):
            return size
        axes = [int(size)] if isinstance(size, (int, float)) else [int(v) for v in size]
        if len(axes) == 1:
            axes *= 3
        if len(axes) != 3:
            raise ValueError(f"a patch size has 1 or 3 values, got {len(axes)}")
        if min(axes) <= 0:
            raise ValueError(f"patch sizes must be positive, got {axes}")
        return cls(*axes)

    @property
    def axes(self) -> tuple[int, int, int]:
        return (self.x, self.y, self.z)

    @property
    def samples(self) -> int:
        return reduce(lambda a, b: a * b, self.axes)

    def require_multiple_of(self, step: int) -> "PatchShape":
        if any(v % step for v in self.axes):
            raise ValueError(f"patch sizes must be multiples of {step}, got {self.axes}")
        return self

    def check_stride(self, stride: int) -> int:
        """A search stride has to divide every patch axis."""
        if stride <= 0 or any(v % stride for v in self.axes):
            raise ValueError(f"stride {stride} does not divide the patch {self.axes}")
        return stride
