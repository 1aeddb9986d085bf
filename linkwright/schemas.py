"""Explicit schemas of the nested inputs."""

DIFFICULTY = "struct<characteristic:int,difficulty:int,stars_t100:bigint,stars_t100_bl:bigint,njs_t100:bigint,bombs:int,notes:int,obstacles:int,mods:bigint>"
SONG = (
    "struct<bpm:float,upvotes:int,downvotes:int,upload_time_unix:bigint,map_id:bigint,song_duration_seconds:int,song_name:string,song_author_name:string,"
    f"level_author_name:string,uploader_name:string,difficulties:array<{DIFFICULTY}>,ranked_change_unix:bigint,ranked_states:bigint,tags:bigint,upload_flags:bigint>"
)
SNAPSHOT = f"format_version int, scrape_ended_time_unix bigint, song_hashes binary, songs array<{SONG}>, tag_list array<string>"

TRACK = (
    "struct<id:string,title:string,isDir:boolean,album:string,artist:string,albumId:string,artistId:string,duration:int,track:int,discNumber:int,year:int,"
    "genre:string,suffix:string,bitRate:int,path:string,coverArt:string,starred:string>"
)
ALBUM = "struct<id:string,name:string,artist:string,songCount:int>"
ARTIST = "struct<id:string,name:string>"
ENVELOPE = (
    "struct<status:string,version:string,error:struct<code:int,message:string>,"
    f"searchResult3:struct<artist:array<{ARTIST}>,album:array<{ALBUM}>,song:array<{TRACK}>>>"
)
PAGE = f"`subsonic-response` {ENVELOPE}"
