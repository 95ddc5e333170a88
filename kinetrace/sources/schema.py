"""Explicit schemas of the sensor tables and the check that a table has the columns a step needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


AXES = tuple(f"{kind}_{axis}" for kind in ("acc", "gyr") for axis in "xyz")

#: One packet of the wire format, counts as the device sends them.
RAW_STREAM = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("group", "node")]
    + [T.StructField(c, _L) for c in ("seq", "node_timestamp_us", "master_timestamp_us")]
    + [T.StructField(c, T.ShortType()) for c in AXES]
)
#: Names and order of the columns of every table, down to VIDEO_METADATA; types are chosen here.
STANDARD_IMU = _table(
    ("session_id", _S), ("player_id", _S), ("sensor_id", _S), ("side", _S), ("seq", _L), ("timestamp_us", _L),
    ("ax", _D), ("ay", _D), ("az", _D), ("gx", _D), ("gy", _D), ("gz", _D), ("mx", _D), ("my", _D), ("mz", _D), ("label", _S),
)
#: Columns that a standard table may have besides.
STANDARD_OPTIONAL = ("qw", "qx", "qy", "qz", "roll", "pitch", "yaw", "linear_acc_x", "linear_acc_y", "linear_acc_z", "uwb_x", "uwb_y", "uwb_z", "uwb_quality")
POSE_LONG = _table(
    ("frame_id", _L), ("timestamp_s", _D), ("fps", _D), ("landmark_id", _L), ("landmark_name", _S), ("x_norm", _D), ("y_norm", _D), ("z_rel", _D), ("visibility", _D),
)
ACTION_LABELS = _table(
    ("session_id", _S), ("player_id", _S), ("label", _S), ("start_time_us", _L), ("end_time_us", _L), ("source", _S), ("confidence", _D), ("video_id", _S), ("notes", _S),
)
DEVICE_STATUS = _table(
    ("session_id", _S), ("timestamp_us", _L), ("device_id", _S), ("device_type", _S), ("battery", _D), ("temperature", _D), ("rssi", _D),
    ("packet_loss_rate", _D), ("firmware_version", _S), ("status", _S), ("notes", _S),
)
EVENT_LABELS = _table(
    ("session_id", _S), ("event_id", _S), ("event_type", _S), ("start_time_us", _L), ("end_time_us", _L), ("primary_player_id", _S),
    ("secondary_player_id", _S), ("team", _S), ("source", _S), ("confidence", _D), ("notes", _S),
)
EVENT_MARKERS = _table(
    ("session_id", _S), ("player_id", _S), ("marker_id", _S), ("timestamp_us", _L), ("marker_type", _S), ("label", _S), ("source", _S), ("operator_id", _S), ("notes", _S),
)
JOINT_ANGLES_2D = _table(
    ("session_id", _S), ("video_id", _S), ("frame_id", _L), ("timestamp_us", _L), ("player_id", _S),
    ("left_elbow_angle", _D), ("right_elbow_angle", _D), ("left_shoulder_angle", _D), ("right_shoulder_angle", _D), ("left_hip_angle", _D), ("right_hip_angle", _D),
    ("left_knee_angle", _D), ("right_knee_angle", _D), ("trunk_angle", _D), ("left_arm_raise_angle", _D), ("right_arm_raise_angle", _D), ("source", _S),
)
MODEL_PREDICTIONS = _table(
    ("session_id", _S), ("player_id", _S), ("window_id", _S), ("start_time_us", _L), ("end_time_us", _L), ("model_name", _S), ("pred_label", _S), ("pred_confidence", _D),
    ("top2_label", _S), ("top2_confidence", _D), ("rule_score", _D), ("xgb_score", _D), ("tsai_score", _D), ("notes", _S),
)
PLAYERS = _table(
    ("session_id", _S), ("player_id", _S), ("player_name", _S), ("dominant_hand", _S), ("height_cm", _D), ("weight_kg", _D), ("skill_level", _S),
    ("left_sensor_id", _S), ("right_sensor_id", _S), ("uwb_tag_id", _S), ("team", _S), ("consent_video", _B), ("consent_data", _B), ("notes", _S),
)
POSE_KEYPOINTS_2D = _table(
    ("session_id", _S), ("video_id", _S), ("frame_id", _L), ("timestamp_us", _L), ("player_id", _S), ("track_id", _S),
    ("nose_x", _D), ("nose_y", _D), ("nose_conf", _D),
    ("left_shoulder_x", _D), ("left_shoulder_y", _D), ("left_shoulder_conf", _D), ("right_shoulder_x", _D), ("right_shoulder_y", _D), ("right_shoulder_conf", _D),
    ("left_elbow_x", _D), ("left_elbow_y", _D), ("left_elbow_conf", _D), ("right_elbow_x", _D), ("right_elbow_y", _D), ("right_elbow_conf", _D),
    ("left_wrist_x", _D), ("left_wrist_y", _D), ("left_wrist_conf", _D), ("right_wrist_x", _D), ("right_wrist_y", _D), ("right_wrist_conf", _D),
    ("left_hip_x", _D), ("left_hip_y", _D), ("left_hip_conf", _D), ("right_hip_x", _D), ("right_hip_y", _D), ("right_hip_conf", _D),
    ("left_knee_x", _D), ("left_knee_y", _D), ("left_knee_conf", _D), ("right_knee_x", _D), ("right_knee_y", _D), ("right_knee_conf", _D),
    ("left_ankle_x", _D), ("left_ankle_y", _D), ("left_ankle_conf", _D), ("right_ankle_x", _D), ("right_ankle_y", _D), ("right_ankle_conf", _D),
    ("pose_model", _S), ("pose_confidence", _D),
)
SENSOR_RAW = _table(
    ("session_id", _S), ("player_id", _S), ("sensor_id", _S), ("side", _S), ("seq", _L), ("t_node_us", _L), ("host_received_us", _L), ("synced_timestamp_us", _L), ("sync_rtt_us", _L),
    ("ax", _D), ("ay", _D), ("az", _D), ("gx", _D), ("gy", _D), ("gz", _D), ("mx", _D), ("my", _D), ("mz", _D), ("qw", _D), ("qx", _D), ("qy", _D), ("qz", _D),
    ("roll", _D), ("pitch", _D), ("yaw", _D), ("linear_acc_x", _D), ("linear_acc_y", _D), ("linear_acc_z", _D), ("gravity_x", _D), ("gravity_y", _D), ("gravity_z", _D),
    ("calibration_status", _S), ("battery", _D), ("rssi", _D), ("sampling_rate", _D), ("firmware_version", _S),
)
SENSORS = _table(
    ("session_id", _S), ("sensor_id", _S), ("player_id", _S), ("side", _S), ("mount_position", _S), ("sensor_model", _S), ("firmware_version", _S),
    ("sampling_rate", _D), ("axis_orientation", _S), ("calibration_status", _S), ("notes", _S),
)
SESSIONS = _table(
    ("session_id", _S), ("session_name", _S), ("date", _S), ("start_time_us", _L), ("end_time_us", _L), ("court_id", _S), ("scenario", _S),
    ("sampling_rate_imu", _D), ("target_sampling_rate_uwb", _D), ("video_available", _B), ("pose_available", _B), ("notes", _S),
)
TRAIN_WINDOWS_INDEX = _table(
    ("window_id", _S), ("session_id", _S), ("player_id", _S), ("start_time_us", _L), ("end_time_us", _L), ("label", _S), ("source", _S),
    ("left_sensor_id", _S), ("right_sensor_id", _S), ("uwb_tag_id", _S), ("video_id", _S), ("frame_start", _L), ("frame_end", _L), ("split", _S), ("notes", _S),
)
UWB_RAW = _table(
    ("session_id", _S), ("player_id", _S), ("uwb_tag_id", _S), ("seq", _L), ("uwb_timestamp_us", _L), ("synced_timestamp_us", _L),
    ("uwb_x", _D), ("uwb_y", _D), ("uwb_z", _D), ("uwb_quality", _D), ("uwb_anchor_count", _I), ("rssi", _D), ("sync_rtt_us", _L),
)
VIDEO_FRAMES = _table(("session_id", _S), ("video_id", _S), ("frame_id", _L), ("timestamp_us", _L), ("frame_index", _L), ("image_path", _S))
VIDEO_METADATA = _table(
    ("session_id", _S), ("video_id", _S), ("camera_id", _S), ("video_path", _S), ("start_time_us", _L), ("end_time_us", _L), ("fps", _D), ("width", _I), ("height", _I),
    ("camera_position", _S), ("camera_angle", _S), ("calibration_file", _S), ("notes", _S),
)
#: Tables that a new collection starts with, and the three that streams, recordings and pose files are read as.
TABLES = {
    "raw_stream": RAW_STREAM, "standard_imu": STANDARD_IMU, "pose_long": POSE_LONG,
    "action_labels": ACTION_LABELS, "device_status": DEVICE_STATUS, "event_labels": EVENT_LABELS, "event_markers": EVENT_MARKERS,
    "joint_angles_2d": JOINT_ANGLES_2D, "model_predictions": MODEL_PREDICTIONS, "players": PLAYERS, "pose_keypoints_2d": POSE_KEYPOINTS_2D,
    "sensor_raw": SENSOR_RAW, "sensors": SENSORS, "sessions": SESSIONS, "train_windows_index": TRAIN_WINDOWS_INDEX, "uwb_raw": UWB_RAW,
    "video_frames": VIDEO_FRAMES, "video_metadata": VIDEO_METADATA,
}

#: Which clock counts where a row has several: the node's own, then synchronised, host and video time.
CLOCKS = ("t_node_us", "synced_timestamp_us", "host_received_us", "video_timestamp_us")
#: Names that recordings use for one thing.
SYNONYMS = {"acc_x_g": "acc_x", "acc_y_g": "acc_y", "acc_z_g": "acc_z", "gyr_x_dps": "gyr_x", "gyr_y_dps": "gyr_y", "gyr_z_dps": "gyr_z"}


class MissingColumns(ValueError):
    """A table lacks columns that it has to have."""


def require(df: DataFrame, columns: list[str] | tuple[str, ...], what: str = "table") -> DataFrame:
    if lacking := [c for c in columns if c not in df.columns]:
        raise MissingColumns(f"{what} lacks {', '.join(lacking)}")
    return df


def column_difference(a: DataFrame, b: DataFrame) -> tuple[set[str], set[str], set[str]]:
    """Columns of the first alone, of the second alone, and of both."""
    mine, other = set(a.columns), set(b.columns)
    return mine - other, other - mine, mine & other


def best_clock(df: DataFrame) -> DataFrame:
    """Adds ``time_us``: the first clock in order of priority that a row has."""
    there = [c for c in CLOCKS if c in df.columns]
    return require(df, there or CLOCKS[:1]).withColumn("time_us", F.coalesce(*[F.col(c) for c in there]))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Aggregates skip nulls and not NaN, so NaN becomes null where a table is read."""
    real = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real})
