"""simlake: functions."""
