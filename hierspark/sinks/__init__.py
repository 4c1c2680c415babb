"""Writers of the output layouts.  Every writer leaves a folder of part files."""
