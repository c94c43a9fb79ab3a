"""Plan shapes that keep wide steps bounded: order statistics, ordered windows, running sums."""
