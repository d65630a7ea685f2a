"""Parameters of the steps."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SkeletonParams:
    remove_small: bool = False
    min_volume: float = 50.0
    closing: bool = True
    opening: bool = False
    gaussian: bool = True
    sigma: float = 0.5

    def __post_init__(self):
        if self.min_volume < 0 or self.sigma <= 0:
            raise ValueError("min_volume must not be negative and sigma must be positive")


@dataclass(frozen=True)
class PlaneParams:
    centre_only: bool = True
    distance: float = 5.0
    start: float = 5.0
    end: float = 0.0
    interpolation: int = 10
    window: int = 150
    order: int = 2

    def __post_init__(self):
        if self.distance <= 0 or self.interpolation < 1 or self.order < 1:
            raise ValueError("distance, interpolation and order must be positive")


@dataclass(frozen=True)
class StreamlineParams:
    ratio: float = 0.02
    least_seeds: int = 50
    seed: int = 0
    max_steps: int = 2000
    least_speed: float = 0.01


@dataclass(frozen=True)
class WallParams:
    viscosity: float = 4.0
    inward: float = 0.6
    parabolic: bool = True
    no_slip: bool = True
    smoothing: int = 200


@dataclass(frozen=True)
class EngineConfig:
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rr: float = 1000.0
    #: Side in voxels of the bricks that cases are cut into; 0: a task takes a whole case's mask.  Results are the same.
    brick: int = 0
    skeleton: SkeletonParams = field(default_factory=SkeletonParams)
    planes: PlaneParams = field(default_factory=PlaneParams)
    streamlines: StreamlineParams = field(default_factory=StreamlineParams)
    wall: WallParams = field(default_factory=WallParams)
