"""DataFrame operators over events, scores, windows, findings and alerts."""
